"""Codecs: golden bytes, round trips, rejection, and bytes that no decoder may crash on."""

import random
import struct
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.codecs import animation, audio, bundle, delta, flat, keyframes, manifest, particles, soundbank, texture, tree, wrappers
from lodestack.codecs.binary import Cursor, FormatError, Writer
from lodestack.codecs.rijndael import Rijndael


def test_cipher_published_vectors():
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert Rijndael(bytes(range(16)), 16).encrypt_block(block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert Rijndael(bytes(range(24)), 16).encrypt_block(block).hex() == "dda97ca4864cdfe06eaf70a0ec0d7191"
    assert Rijndael(bytes(range(32)), 16).encrypt_block(block).hex() == "8ea2b7ca516745bfeafc49904b496089"


@given(st.binary(max_size=200), st.text(min_size=1, max_size=8))
@settings(max_examples=25, deadline=None)
def test_wrappers_round_trip(data, seed):
    for variant in ("compact", "extended"):
        assert wrappers.unwrap_container(wrappers.wrap_container(data, variant)) == data
        assert wrappers.decode_text(wrappers.encode_text(data, seed, variant), seed) == data
    assert wrappers.xor_unwrap(wrappers.xor_wrap(data, b"key", 16), b"key", 16) == data
    assert wrappers.cipher_unwrap(wrappers.cipher_wrap(data + b"\1", seed), seed) == data + b"\1"


def test_wrappers_reject():
    good = wrappers.wrap_container(b"x" * 100)
    for bad in (b"", good[:7], b"\0" + good[1:], good[:4] + b"\1\0\0\0" + good[8:], good[:-6]):
        with pytest.raises(FormatError):
            wrappers.unwrap_container(bad)
    with pytest.raises(FormatError):
        wrappers.unwrap_container(good, limit=10)
    with pytest.raises(FormatError):
        wrappers.xor_wrap(b"x" * 300, b"")
    assert wrappers.xor_wrap(b"short", b"") == b"short"
    assert wrappers.parse_key("0a 0B", "hex") == b"\x0a\x0b"
    assert wrappers.md5_tag(b"") == "D41D8CD98F00B204E9800998ECF8427E\r\n"


scalars = st.one_of(
    st.just(("null", None)), st.booleans().map(lambda x: ("bool", x)), st.integers(-(1 << 31), (1 << 31) - 1).map(lambda x: ("i32", x)), st.integers(0, (1 << 64) - 1).map(lambda x: ("u64", x)),
    st.integers(-(1 << 63), (1 << 63) - 1).map(lambda x: ("i64", x)), st.integers(0, 255).map(lambda x: ("u8", x)), st.floats(allow_nan=False, width=32).map(lambda x: ("f32", x)),
    st.floats(allow_nan=False).map(lambda x: ("f64", x)), st.text(max_size=6).filter(lambda x: x != "RTID(0)" and "\0" not in x).map(lambda x: ("str", x)), st.binary(max_size=6).map(lambda x: ("bin", x)),
)
values = st.recursive(scalars, lambda x: st.one_of(st.lists(x, max_size=3).map(lambda v: ("array", v)), st.lists(st.tuples(st.sampled_from(["a", "é", "日"]), x), max_size=3).map(lambda v: ("object", v))), max_leaves=12)


def narrowed(value):
    """What the standard form keeps: a small non-negative 32-bit value of either sign reads back as signed where raw."""
    tag, x = value
    if tag == "array":
        return tag, [narrowed(v) for v in x]
    if tag == "object":
        return tag, [(k, narrowed(v)) for k, v in x]
    return value


@given(st.lists(st.tuples(st.text(max_size=4).filter(lambda x: x != "RTID(0)" and "\0" not in x), values), max_size=5))
@settings(max_examples=120, deadline=None)
def test_tree_round_trips(entries):
    root = ("object", entries)
    assert tree.decode(tree.encode_compact(root)) == root
    assert tree.decode(tree.encode(root)) == narrowed(root)


def test_tree_golden_bytes():
    root = ("object", [("a", ("u8", 5)), ("a", ("i32", -1)), ("b", ("str", "a"))])
    assert tree.encode(root) == b"RTON\x01\0\0\0" + b"\x90\x01a\x0a\x05" + b"\x91\x00\x25\x01" + b"\x90\x01b\x91\x00" + b"\xffDONE"


def test_tree_rejects():
    good = tree.encode(("object", [("k", ("array", [("u8", 1)]))]))
    for bad in (b"", b"RTOX" + good[4:], good[:-1], good.replace(b"\xfd\x01", b"\xfd\x00"), good.replace(b"\xfd", b"\xfc")):
        with pytest.raises(FormatError):
            tree.decode(bad)
    assert tree.decode(good + b"tail") == tree.decode(good)


def test_typed_ids_both_dialects():
    uid = tree.parse_rtid("RTID(1a.2.0000000b@name)")
    assert (uid["id"], uid["group"], uid["obj"], uid["name"]) == (26, 2, 11, "name")
    assert tree.format_rtid(uid, runtime=True) == "RTID(26.2.0000000b@name)"
    assert tree.parse_rtid("RTID(26.2.0000000b@name)", runtime=True) == uid
    assert tree.parse_rtid("RTID(:3.4@5)")["obj"] == 5 and tree.parse_rtid("RTID(x@y)")["parent"] == "y" and tree.parse_rtid("RTID(0)")["kind"] == "null"
    with pytest.raises(FormatError):
        tree.parse_rtid("RTID()")


def test_json_keeps_repeated_keys_and_narrows():
    root = tree.from_json('{"a": 1, "a": -200, "b": 70000, "c": 1.5, "d": null}')
    assert [v for _, v in root[1]] == [("u8", 1), ("i16", -200), ("u32", 70000), ("f64", 1.5), ("null", None)]
    assert tree.from_json(tree.to_json(root)) == root


@pytest.mark.parametrize("flags", range(4))
def test_packets(flags):
    files = [{"path": p, "is_part1": p.endswith("X"), "part1": {"id": 0, "width": 8, "height": 4} if p.endswith("X") else None, "data": d} for p, d in [("A\\B", b""), ("A\\B.T", b"q" * 5000), ("a\\c.X", b"\1" * 256), ("Z", b"z")]]
    back = bundle.unpack_packet(bundle.pack_packet(files, 4, flags))
    assert sorted((f["path"], f["data"], f["part1"] and f["part1"]["width"]) for f in back) == sorted((f["path"], f["data"], f["part1"] and f["part1"]["width"]) for f in files)


def test_bundle_tables():
    packet = bundle.pack_packet([{"path": "t.X", "is_part1": True, "part1": {"id": 0, "width": 8, "height": 8}, "data": b"\2" * 256}])
    texture_row = {"ptx_index": 0, "width": 8, "height": 8, "pitch": 32, "format": 0, "alpha_size": 7, "alpha_format": 1}
    description = [{"group": "G_CompositeShell", "composite": False, "subgroup": "S", "resolution": "768", "language": "EN", "id": "R", "type": 0, "path": "p", "image": None, "properties": {"k": "v"}}]
    data = bundle.build_bundle([{"name": "pk", "data": packet, "pool_index": 3, "ptx_number": 1, "ptx_before": 0}], [texture_row], [{"name": "C", "is_composite": False, "packets": [{"packet_index": 0, "category": ["0", "EN"]}]}],
                               [{"name": "a", "part0_size": 1, "part1_size": 2}], [{"path": "T.X", "pool_index": 3}], description, texture_size=0x18)
    head = bundle.read_head(data)
    assert bundle.read_textures(data, head) == [texture_row] and bundle.read_description(data, head) == description
    assert bundle.read_composites(data, head)[0]["name"] == "C" and not bundle.read_composites(data, head)[0]["is_composite"]
    assert bundle.read_file_list(data, head) == [{"path": "T.X", "pool_index": 3}]
    assert bundle.unpack_bundle(data)[0]["texture"] == texture_row
    assert bundle.metadata_size(head) == head["information_size"] and bundle.metadata_size(head, False) == head["information_without_manifest_size"]


@pytest.mark.parametrize("profile,compression", list(product(("xor", "plain", "aligned", "zip"), ("none", "zlib"))))
def test_flat_archives(profile, compression):
    entries = [(flat.Entry(b"a/b.txt", time={"kind": "none", "value": None, "date": None, "clock": None}), b"hello" * 50), (flat.Entry(b"a/b.txt"), b"again" * 9), (flat.Entry(b"z"), b"xy" * 30)]
    data = flat.write(entries[1:] if profile == "zip" else entries, profile, compression)
    index = flat.read_index(data)
    assert (index.profile, index.compression) == (profile, compression)
    assert [flat.read_entry(data, index, k) for k in range(len(index.entries))] == [d for _, d in (entries[1:] if profile == "zip" else entries)]
    with pytest.raises(FormatError):
        flat.read_index(data[:-3])


def test_flat_probing():
    assert (flat.read_index(flat.write([], "aligned", "zlib")).profile, flat.read_index(flat.write([], "xor", "zlib")).compression) == ("plain", "none")
    with pytest.raises(flat.NoLayout) as e:
        flat.read_index(flat.write([(flat.Entry(b"a"), b"12345")], "plain") + b"!")
    assert len(e.value.attempts) == 6
    with pytest.raises(FormatError, match="at most 1"):
        flat.read_index(flat.write([(flat.Entry(b"a"), b""), (flat.Entry(b"b"), b"")], "xor"), exact=("xor", "none"), limits=flat.Limits(entries=1))
    legacy = flat.write([(flat.Entry(b"a"), b"12345" * 100)], "plain", "zlib")
    stored, size = struct.unpack_from("<II", legacy, 11)
    swapped = legacy[:11] + struct.pack("<II", size, stored) + legacy[19:]
    assert flat.read_index(swapped).layout == "legacy"


RESOURCE = dict.fromkeys(("width", "height", "x", "y", "ax", "ay", "aw", "ah", "cols", "rows", "parent")) | {"type": "File", "slot": 0, "id": "i", "path": "p", "atlas": False}


def test_manifest_golden_bytes():
    m = {"slot_count": 1, "groups": [{"kind": "composite", "id": "c", "resolution": None, "parent": None, "subgroups": [{"resolution": 2, "id": "s"}], "resources": []},
                                     {"kind": "simple", "id": "s", "resolution": 2, "parent": "c", "subgroups": [], "resources": [RESOURCE]}]}
    i = lambda *x: struct.pack(f"<{len(x)}i", *x)
    want = i(1, 2) + b"\1" + i(0, 1, 0) + b"\1\0" + i(1) + b"c" + i(2, 1) + b"s" + b"\2" + i(2, 0, 1) + b"\1\1" + i(1) + b"s" + i(1) + b"c"
    want += b"\4" + i(0, 0, 0, 2**31 - 1, 2**31 - 1, 0, 0, 0, 0, 1, 1) + b"\0\1\1\0" + i(1) + b"i" + i(1) + b"p"
    assert manifest.encode(m) == want and manifest.decode(want) == m
    for bad in (want[:-1], want + b"x", b"\xff" * 8, want[:8] + b"\3" + want[9:]):
        with pytest.raises(FormatError):
            manifest.decode(bad)


def test_keyframes_and_layout_detection():
    frame = dict.fromkeys(keyframes.FIELDS + keyframes.TEXTS)
    a = {"fps": 12.0, "tracks": [{"name": "t", "frames": [frame | {"x": 1.5, "i": "7"}, frame | {"f": -1.0, "text": "é"}]}, {"name": "", "frames": []}]}
    for layout in keyframes.LAYOUTS:
        assert keyframes.decode(keyframes.encode(a, layout)) == (a, layout)
    assert keyframes.decode_as(keyframes.encode({"fps": 1.0, "tracks": [{"name": "", "frames": [frame | {"x": -10000.0}]}]}), "pc")["tracks"][0]["frames"][0]["x"] is None


@pytest.mark.parametrize("version", range(1, 7))
def test_animations(version):
    change = {"index": 2000, "transform": [1.0, 0.0, 0.5, 1.0, 2.0, 3.0], "source_rectangle": {"position": [1.0, 2.0], "size": [3.0, 4.0]}, "color": [0.0, 1.0, 0.2, 0.0], "sprite_frame_number": 4}
    append = {"index": 5, "name": "n", "resource": 300 if version == 6 else 7, "sprite": True, "additive": False, "preload_frame": 2, "time_scale": 1.5}
    frame = {"label": "l", "stop": True, "command": [["a", "b"]], "remove": [{"index": k} for k in range(300)], "append": [append], "change": [change]}
    sprite = {"name": "s" if version >= 4 else None, "frame_rate": 30.0 if version >= 4 else None, "work_area": [0, 1] if version >= 5 else None, "frame": [frame]}
    a = {"version": version, "frame_rate": 30, "position": [1.0, -2.0], "size": [390.0, 390.0], "image": [{"name": "i", "size": [3, 4] if version >= 4 else None, "transform": [0.5, 1.0, 2.0] if version == 1 else [1.0, 0.0, 0.0, 1.0, 0.5, 0.0]}], "sprite": [], "main_sprite": sprite}
    assert animation.decode(animation.encode(a)) == a
    assert {e["op"] for e in animation.events(a)} == {"remove", "append", "change", "stop"}


def test_curves():
    assert particles.parse_curve("  ") == []
    nodes = particles.parse_curve("[1 2],50 EaseIn 0 3,100 [4]")
    assert [(n["time"], n["low"], n["high"], n["curve_type"]) for n in nodes] == [(0.5, 1.0, 2.0, 2), (0.0, None, None, None), (1.0, 3.0, 3.0, None), (0.0, 4.0, 4.0, None)]
    assert particles.format_curve(nodes) == "[1 2],50 EaseIn 0 3,100 4"
    e = dict.fromkeys((*particles.CURVES, "image", "image_col", "image_row", "image_frames", "animated", "name", "on_duration", "field", "system_field")) | {"particle_flags": 9, "emitter_type": 2, "image": "7", "spawn_rate": nodes, "field": [{"field_type": 3, "x": nodes, "y": None}]}
    for layout in particles.LAYOUTS:
        assert particles.decode_as(particles.encode([e], layout), layout) == [e]
    assert particles.from_xml(particles.to_xml([e]))[0]["field"] == e["field"]


def test_textures():
    image = np.random.default_rng(0).integers(0, 256, (37, 45, 4)).astype(np.uint8)
    for form in ("rgba8888", "argb8888", "rgb888", "rgba4444", "rgb565", "rgba5551", "rgb332", "a8", "argb4444", "argb1555", "rgb565_tiled", "rgba4444_tiled", "rgba5551_tiled"):
        data = texture.encode(image, form)
        assert len(data) == texture.payload_size(form, 45, 37) and texture.encode(texture.decode(data, form, 45, 37), form) == data
    assert (texture.decode(texture.encode(image, "rgba8888", order="bgra", pitch=200), "rgba8888", 45, 37, 200, "bgra") == image).all()
    assert texture.decode(b"\xf0", "la44", 1, 1).tolist() == [[[0, 0, 0, 255]]] and texture.decode(b"\xf0", "al44", 1, 1).tolist() == [[[255, 255, 255, 0]]]
    smooth = np.zeros((16, 16, 4), np.uint8)
    smooth[..., 0], smooth[..., 1], smooth[..., 3] = np.arange(16) * 9, np.arange(16)[:, None] * 9, np.arange(16) * 17
    for form in ("etc1_a8", "etc1_alpha", "etc1_palette"):
        back = texture.decode(texture.encode(smooth, form), form, 16, 16).astype(int)
        assert np.abs(back - smooth)[..., :3].mean() < 6 and np.abs(back[..., 3] - smooth[..., 3]).max() <= 8
    assert (texture.from_png(texture.to_png(image)) == image).all()
    assert texture.resolve(147, 8, 8, 32) == "etc1" and texture.resolve(147, 8, 8, 32 + 64) == "etc1_a8" and texture.resolve(147, 8, 8, 64) == "etc1_alpha" and texture.resolve(30, 8, 8, 32) == "pvrtc4"
    with pytest.raises(FormatError):
        texture.decode(b"", "rgb565", 2, 2)


def test_etc1_known_block():
    # both halves black and white in four bits, no step: code 0 of table 0 adds 2
    block = (0xF << 60 | 0xF << 52 | 0xF << 44).to_bytes(8, "big")
    out = texture.decode(block, "etc1", 4, 4)
    assert out[0, 0].tolist() == [255, 255, 255, 255] and out[0, 3].tolist() == [2, 2, 2, 255]


def test_pvrtc_flat_and_mixed_blocks():
    red, blue = 1 << 14 | 31 << 9, 1 << 15 | 31  # opaque: five, five and four bits; five, five and five
    for code, want in ((0, [255, 0, 0, 255]), (3, [0, 0, 255, 255]), (1, [159, 0, 95, 255])):
        word = int(f"{code:02b}" * 16, 2) | red << 33 | blue << 48
        image = texture.decode(struct.pack("<Q", word) * 8, "pvrtc4", 16, 8)
        assert image.shape == (8, 16, 4) and (image == want).all()
    punched = int("10" * 16, 2) | 1 << 32 | red << 33 | blue << 48
    assert texture.decode(struct.pack("<Q", punched), "pvrtc4", 4, 4)[0, 0, 3] == 0
    assert texture.decode(struct.pack("<Q", punched) + bytes(range(16)), "pvrtc4_a8", 4, 4)[..., 3].reshape(-1).tolist() == list(range(16))
    with pytest.raises(FormatError):
        texture.decode(bytes(72), "pvrtc4", 12, 12)
    # one bright block among dark ones fades by quarters to both sides
    words = [0 | 1 << 47 | 1 << 63] * 16
    words[texture._interleaved(4, 4)[1, 1]] = (31 << 9) << 33 | 1 << 47 | 1 << 63
    row = texture.decode(struct.pack("<16Q", *words), "pvrtc4", 16, 16)[6, :, 0].tolist()
    assert row == [0, 0, 0, 63, 127, 191, 255, 191, 127, 63, 0, 0, 0, 0, 0, 0]


def test_audio():
    samples = (np.sin(np.arange(2000) * 0.01) * 9000).astype("<i2")
    wav = audio.wav(samples.tobytes(), 2, 44100, 16)
    assert audio.decode(audio.encode(wav, "pcm")) == wav
    back = audio.decode(audio.encode(wav, "adpcm"))
    heard = np.frombuffer(back[44:], "<i2")[:2000].astype(int)
    assert np.abs(heard - samples).mean() < 120 and audio.inspect(audio.encode(wav, "adpcm"))["codec"] == "adpcm"
    big = b"RIFX" + struct.pack(">I", 38) + b"WAVEfmt " + struct.pack(">I2H2I2H", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack(">I", 2) + struct.pack(">h", 258)
    assert audio.decode(big)[44:] == struct.pack("<h", 258)
    assert audio.inspect(wav[:-4])["truncated"]
    frame = lambda n: bytes([0xFF, 0xF1, 4 << 2 | 0, 2 << 6 | (n + 7) >> 11, (n + 7) >> 3 & 255, ((n + 7) & 7) << 5, 0]) + bytes(n)
    stream = frame(100) + frame(300)
    assert audio.probe_adts(stream) == {"channels": 2, "sample_rate": 44100, "byte_rate": -(-len(stream) * 44100 // 2048)}
    wrapped = audio.wrap_aac(stream)
    assert audio.extract_aac(wrapped) == stream and audio.inspect(wrapped)["codec"] == "aac"
    with pytest.raises(FormatError):
        audio.wrap_aac(b"not a frame")
    for bad in (b"", b"RIFF", wav[:20], wav.replace(b"data", b"dat_")):
        with pytest.raises(FormatError):
            audio.inspect(bad)


@given(st.binary(max_size=300), st.lists(st.tuples(st.integers(0, 299), st.integers(0, 200)), max_size=4), st.binary(max_size=40), st.booleans())
@settings(max_examples=100, deadline=None)
def test_deltas_round_trip(source, cuts, extra, interleaved):
    target = b"".join(source[a : a + n] for a, n in cuts) + extra
    assert delta.decode(source, delta.encode(source, target, interleaved)) == target


def test_delta_windows():
    head = b"\xd6\xc3\xc4\0\0"
    assert delta.decode(b"", head + b"\0\x09\x03\0\x03\x01\0abc\x04") == b"abc"  # ADD 3
    assert delta.decode(b"", head + b"\0\x08\x05\0\x01\x02\0z\0\x05") == b"zzzzz"  # RUN 5
    assert delta.decode(b"abcd", head + b"\x01\x04\0\x07\x04\0\0\x01\x01\x14\0") == b"abcd"  # COPY 4
    checked = b"\xd6\xc3\xc4S\0\x04"
    number = bytearray()
    delta.put_number(number, zlib.adler32(b"abc"))
    body = b"\x03\0\0\x04\0" + bytes(number) + b"\x04abc"
    assert delta.decode(b"", checked + bytes([len(body)]) + body) == b"abc"
    with pytest.raises(FormatError, match="checksum"):
        delta.decode(b"", checked + bytes([len(body)]) + body[:-1] + b"d")
    with pytest.raises(FormatError):
        delta.decode(b"", delta.encode(b"", b"x" * 100), limit=50)


def test_bundle_patches():
    packet = lambda t, flags: bundle.pack_packet([{"path": "a", "is_part1": False, "part1": None, "data": t * 700}], 4, flags)
    make = lambda items: bundle.build_bundle([{"name": n, "data": d, "pool_index": k, "ptx_number": 0, "ptx_before": 0} for k, (n, d) in enumerate(items)], [], [], [], [])
    before, after = make([("one", packet(b"hello ", 3)), ("gone", packet(b"x", 0)), ("two", packet(b"same", 1))]), make([("one", packet(b"hellO ", 3)), ("two", packet(b"same", 1)), ("new", packet(b"n", 2))])
    for raw in (False, True):
        patch = delta.read_patch(delta.write_patch(delta.create_patch(before, after, raw)))
        assert [p["patch"] is None for p in patch["packets"]] == [False, True, False]
        out = delta.apply_patch(before, patch, raw)
        assert [(f["packet"], f["path"], f["data"]) for f in bundle.unpack_bundle(out)] == [(f["packet"], f["path"], f["data"]) for f in bundle.unpack_bundle(after)]
        with pytest.raises(FormatError, match="not what the delta"):
            delta.apply_patch(after, patch, raw)


DECODERS = {
    "tree": tree.decode, "flat": flat.read_index, "packet": bundle.unpack_packet, "bundle": bundle.unpack_bundle, "manifest": manifest.decode, "keyframes": keyframes.decode, "animation": animation.decode,
    "particles": particles.decode, "trail": particles.decode_trail, "audio": audio.decode, "patch": delta.read_patch, "delta": lambda d: delta.decode(b"abc", d), "container": wrappers.unwrap_container,
}
SEEDS = {
    "tree": tree.encode(("object", [("k", ("array", [("u8", 1), ("str", "é")]))])), "flat": flat.write([(flat.Entry(b"a"), b"1" * 50)], "plain", "zlib"), "packet": bundle.pack_packet([{"path": "a", "is_part1": False, "part1": None, "data": b"1"}]),
    "manifest": manifest.encode({"slot_count": 1, "groups": [{"kind": "simple", "id": "s", "resources": [RESOURCE]}]}), "audio": audio.wav(b"\0" * 20, 1, 8, 16), "delta": delta.encode(b"abc", b"x" * 40), "container": wrappers.wrap_container(b"q"),
}


@pytest.mark.parametrize("name", DECODERS)
def test_no_decoder_crashes(name):
    r = random.Random(name)
    seed = SEEDS.get(name, b"")
    for k in range(400):
        data = bytearray(seed if k % 2 and seed else r.randbytes(r.randrange(200)))
        for _ in range(r.randrange(4)):
            if data:
                data[r.randrange(len(data))] = r.randrange(256)
        data = bytes(data[: r.randrange(len(data) + 1)]) if k % 3 == 0 else bytes(data)
        try:
            DECODERS[name](data)
        except (FormatError, UnicodeDecodeError):
            pass


@pytest.mark.parametrize("version", soundbank.VERSIONS)
def test_bank_settings_by_version(version):
    w = Writer()
    if version >= 145:
        w.put("H", 1)
    w.put("fH", -80.0, 32)
    if version >= 128:
        w.put("H", 50)
    w.put("3I4I", 1, 7, 100, 1, 1, 2, 3)  # one state group with one transition
    w.put("3I", 1, 8, 9)
    if version >= 112:
        w.put("B", 0)
    w.put("IfII", 1, 0.5, 4, 5)
    w.put("2If", 1, 10, 2.0)
    if version >= 112:
        w.put("I2fB", 0, 1.0, 1.0, 0)
    if version >= 140:
        w.put("2I6f", 1, 11, *range(6))
    else:
        w.raw(bytes(8 if 120 <= version < 125 else 4 if 125 <= version < 140 else 0))
    found = soundbank.settings(version, w.done())
    assert found["state_groups"][0]["custom_transitions"] == [{"from": 1, "to": 2, "time": 3}] and found["switch_groups"][0]["points"] == [{"x": 0.5, "y": 4, "curve": 5}]
    assert ("attack" in found["game_parameters"][0]) == (version >= 112) and ("u1" in found) == (version >= 140)
    with pytest.raises(FormatError):
        soundbank.settings(version, w.done() + b"x")
    curves = b"\1\0\1\0" + struct.pack("<2fI", 1.0, 2.0, 4)
    assert len(soundbank.environments(version, curves * (6 if version >= 112 else 4))) == (6 if version >= 112 else 4)
    action = {"kind": "EventAction", "body": b"\x03\x04" + struct.pack("<IB", 77, 0) + b"pay"}
    assert {f["path"]: f["value"] for f in soundbank.fields(version, action)}["target"] == "77"


def test_bank_plugins():
    assert soundbank.plugins(140, struct.pack("<2I", 1, 5) + b"lib\0") == [{"id": 5, "library": "lib"}]
    assert soundbank.plugins(118, struct.pack("<3I", 1, 5, 4) + b"lib\0") == [{"id": 5, "library": "lib"}]
    assert soundbank.platform(150, b"Windows\0") == soundbank.platform(118, struct.pack("<I", 8) + b"Windows\0") == soundbank.platform(113, struct.pack("<I", 7) + b"Windows") == "Windows"
    assert soundbank.references(struct.pack("<3IB", 1, 1, 9, 3) + b"abc") == [{"id": 9, "name": "abc"}]
    for bad in ((112, b""), (118, struct.pack("<3I", 1, 5, 3) + b"lib")):
        with pytest.raises(FormatError):
            soundbank.plugins(*bad)


def test_cursor_and_writer():
    w = Writer()
    for n in (0, 127, 128, 1 << 40):
        w.varint(n)
    c = Cursor(w.done())
    assert [c.varint() for _ in range(4)] == [0, 127, 128, 1 << 40] and c.left == 0
    with pytest.raises(FormatError):
        Cursor(b"\x80" * 20).varint()
    with pytest.raises(FormatError):
        Writer().put("B", 300)
