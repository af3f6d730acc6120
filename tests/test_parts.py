"""Bits, detached indexes, single fields, media in blocks, and links on the way to a file."""

import io
import os
import random

import pytest

from lodestack.codecs import bits, flat, soundbank
from lodestack.codecs.binary import FormatError
from lodestack.operators import keyed, ordered, ranges
from lodestack.sinks import files as sink


def test_bits_round_trip():
    r = random.Random(1)
    for _ in range(200):
        parts = [(r.randrange(1 << w), w) for w in (r.randrange(33) for _ in range(r.randrange(20)))]
        w = bits.BitWriter()
        for value, width in parts:
            w.write(value, width)
        back = bits.BitReader(w.done())
        assert [back.read(width) for _, width in parts] == [v for v, _ in parts]
    assert bits.BitReader(b"\x01\x80").read(16) == 0x8001
    for bad in (lambda: bits.BitReader(b"a").read(9), lambda: bits.BitReader(b"abcde").read(33), lambda: bits.BitWriter().write(2, 1)):
        with pytest.raises(FormatError):
            bad()


def test_an_index_without_its_archive():
    data = flat.write([(flat.Entry(b"a/\xff"), b"hello" * 9), (flat.Entry(b"b"), b"")], "plain", "zlib")
    whole = b"before" + data + b"after"
    index = flat.read_index(flat.sub_range(whole, 6, len(data)))
    again = flat.attached(flat.detached(index), data)
    assert again == index and flat.read_entry(data, again, 0) == b"hello" * 9
    with pytest.raises(FormatError):
        flat.attached(flat.detached(index), data[:20])
    with pytest.raises(FormatError):
        flat.sub_range(whole, 5, len(whole))


@pytest.mark.parametrize("version", (72, 125, 128, 150))
def test_fields_are_replaced_in_place(version):
    import struct

    count = (lambda n: bytes([n])) if version < 128 else (lambda n: struct.pack("<H", n))
    state = {"kind": "StatefulPropertySetting", "id": 1, "body": count(2) + count(7) + count(9) + struct.pack("<2f", 1.5, 2.5)}
    out, before = soundbank.replace_field(version, state, "values[1].value", 8.0)
    assert before == "2.5" and [f["value"] for f in soundbank.fields(version, out)] == ["7", "1.5", "9", "8.0"]
    out, before = soundbank.replace_field(version, out, "values[1].type", 200)
    assert before == "9" and [f["value"] for f in soundbank.fields(version, out)] == ["7", "1.5", "200", "8.0"]
    action = {"kind": "EventAction", "id": 2, "body": b"\x03\x04" + struct.pack("<IB", 77, 0) + b"pay"}
    out, _ = soundbank.replace_field(version, action, "payload", b"xyz")
    out, _ = soundbank.replace_field(version, out, "target", 78)
    assert out["body"] == b"\x03\x04" + struct.pack("<IB", 78, 0) + b"xyz"
    for path, value in (("target", 1.0), ("target", 1 << 32), ("target", True), ("payload", b"four"), ("nothing", 1), ("scope_and_mode", 6)):
        with pytest.raises(FormatError):
            soundbank.replace_field(version, action, path, value)


def test_media_in_blocks():
    bank = {"version": 140, "bank_id": 7, "language": 0, "expand": b"", "chunks": []}
    data = soundbank.write(soundbank.with_media(bank, [(0, b""), (3, b"abc" * 50_000), (9, b"q"), (3, b"later")]))

    class Counted(io.BytesIO):
        largest = 0

        def write(self, part):
            Counted.largest = max(Counted.largest, len(part))
            return super().write(part)

    out = Counted()
    assert soundbank.copy_media(io.BytesIO(data), 3, out) and out.getvalue() == b"abc" * 50_000 and Counted.largest == 64 << 10
    assert not soundbank.copy_media(io.BytesIO(data), 4, io.BytesIO())
    with pytest.raises(FormatError):
        soundbank.copy_media(io.BytesIO(data[:-100_000]), 3, io.BytesIO())


def test_links_on_the_way_are_refused(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "elsewhere").mkdir()
    os.symlink(tmp_path / "elsewhere", tmp_path / "out/link")
    df = spark.createDataFrame([("link/a", b"1")], "path string, data binary")
    with pytest.raises(Exception, match="symbolic link"):
        sink.write_files(df, str(tmp_path / "out"))
    assert not list((tmp_path / "elsewhere").iterdir())


def test_folds_and_ranges_against_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), k, r.choice([None, r.random() * 4])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(3)
    got = {x.k: x.e for x in ordered.tolerance_delta(df, ["g"], ["k"], "v", 0.7, "e").collect()}
    last = {"a": 0.0, "b": 0.0}
    for g, k, v in rows:
        new = v is not None and abs(v - last[g]) > 0.7
        assert got[k] == (v if new else None)
        last[g] = v if new else last[g]
    holes = [(r.randrange(-20, 20_000), r.randrange(0, 3000)) for _ in range(6)]
    index = spark.range(-10, 20_000, 7).withColumnRenamed("id", "i")
    out = [x.n for x in ordered.remove_ranges(index, "i", spark.createDataFrame(holes, "low long, n long"), "low", "n", "n").orderBy("i").collect()]
    assert out == list(range(sum(not any(a <= i < a + n for a, n in holes) for i in range(-10, 20_000, 7))))


def test_as_of_over_buckets(spark):
    r = random.Random(3)
    left = [(r.choice("ab"), r.randrange(400), k) for k in range(120)]
    right = [(r.choice("ab"), r.randrange(400), 1000 + k) for k in range(40)]
    a, b = (spark.createDataFrame(x, "g string, t long, i long") for x in (left, right))
    from pyspark.sql import functions as F

    for bucket in (None, F.floor(F.col("t") / 30)):
        got = {x.i: x.last_i for x in ranges.as_of(a, b, ["g"], "t", ["i"], "i", bucket=bucket).collect()}
        for g, t, i in left:
            before = [(u, j) for h, u, j in right if h == g and u <= t]
            assert got[i] == (max(before)[1] if before else None)


def test_first_conflict_of_many_rows(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    rows = [(r.choice("xy"), k, r.randrange(3)) for k in range(200)]
    df = spark.createDataFrame(rows, "id string, o long, p long")
    got = {(x.id, x.o): x.earlier_o for x in keyed.first_conflict(df, ["id"], "o", F.col("p") == F.col("earlier_p"), ["p"]).collect()}
    want = {}
    for i, k, p in rows:
        before = [o for j, o, q in rows if j == i and o < k and q != p]
        if before:
            want[i, k] = min(before)
    assert got == want


def test_shards_of_archives_follow_one_another(spark):
    from pyspark.sql import functions as F

    from lodestack.sources.tables import decode

    r = random.Random(5)
    rows = [(r.choice("xyz") if k % 9 else None, f"f{k:03}", bytes([k % 256]) * r.randrange(40)) for k in range(300)]
    df = spark.createDataFrame(rows, "source string, path string, data binary").repartition(4)
    shards = sink.flat_shards(df, "source", shard_bytes=300)
    files = decode(shards.withColumn("archive", F.to_json("archive")), "flat.files", "archive", "data", strict=True)
    files = files.withColumn("s", F.from_json("file", "key string, shard long, first long")).collect()
    assert len({(x.s.key, x.s.shard) for x in files}) > 10
    for key in ("x", "y", "z", None):
        own = sorted((x.s.first + x.ordinal, x.path, x.data) for x in files if x.s.key == key)
        want = sorted((p, d) for s, p, d in rows if s == key)
        assert [n for n, _, _ in own] == list(range(len(own))) and [(p, d) for _, p, d in own] == want
    sizes = {}
    for x in files:
        sizes[x.s.key, x.s.shard] = sizes.get((x.s.key, x.s.shard), 0) + len(x.data)
    assert max(sizes.values()) < 300 + 40


def test_property_descriptors():
    from lodestack.codecs import bank_properties as p

    name = lambda v, d, i: (p.descriptor(v, d, i) or {}).get("name")
    assert [name(v, "audio", 5) for v in (72, 88, 112, 118, 128, 150)] == ["playback_priority_value", "playback_priority_value", "bus_volume", "bus_volume", "bus_volume", "voice_volume_make_up_gain"]
    assert [name(v, "audio", 9) for v in (72, 118, 128, 150)] == ["motion_low_pass_filter", "motion_volume_offset", None, "user_defined_auxiliary_send_volume_1"]
    assert [name(v, "audio", 71) for v in (128, 132, 149, 150)] == [None, "positioning_listener_routing_speaker_panning_division_spatialization_mix"] + ["positioning_listener_routing_speaker_panning_division_spatialization_mix", None]
    assert [name(v, "event_action", i) for v, i in ((117, 14), (118, 14), (118, 15), (150, 59))] == ["delay", None, "delay", "probability"]
    assert name(88, "modulator", 0) is None and name(112, "modulator", 9) == "attack_time" and name(150, "modulator", 9) is None
    # an identifier means one thing in a version
    for d in p.descriptors():
        for e in p.descriptors():
            if d is not e and (d["domain"], d["value"]) == (e["domain"], e["value"]):
                assert (d["until"] or 10**9) <= e["since"] or (e["until"] or 10**9) <= d["since"]
    for kind, value in (("boolean", True), ("integer", -5), ("float", 0.5), ("enumerated", 3), ("identifier", 2**32 - 1)):
        assert p.read_value(kind, p.write_value(kind, value)) == value
    for bad in (lambda: p.write_value("integer", 1.0), lambda: p.write_value("identifier", -1), lambda: p.read_value("boolean", b"\2\0\0\0"), lambda: p.read_value("float", b"")):
        with pytest.raises(FormatError):
            bad()


def test_pvrtc_images_come_back_near():
    import numpy as np

    from lodestack.codecs import texture

    y, x = np.mgrid[:32, :64]
    smooth = np.stack([x * 4, y * 8, 255 - x * 2, np.full_like(x, 255)], -1).astype(np.uint8)
    clear = smooth.copy()
    clear[..., 3] = 255 - y * 4
    for image, form, most in ((smooth, "pvrtc4", 12), (clear, "pvrtc4", 20), (clear, "pvrtc4_a8", 12)):
        data = texture.encode(image, form)
        back = texture.decode(data, form, 64, 32).astype(int)
        assert np.abs(back - image)[2:-2, 2:-2].mean() < most, (form, np.abs(back - image)[2:-2, 2:-2].mean())
        if form == "pvrtc4_a8":
            assert (back[..., 3] == image[..., 3]).all()
    flat = np.zeros((16, 8, 4), np.uint8)
    flat[:] = (255, 0, 132, 255)
    assert (texture.decode(texture.encode(flat, "pvrtc4"), "pvrtc4", 8, 16) == flat).all()
    with pytest.raises(FormatError):
        texture.encode(flat[:12], "pvrtc4")
