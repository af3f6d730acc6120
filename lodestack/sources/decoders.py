"""What each table of a format has: its schema, and how one file's bytes become its rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from decimal import Decimal

from ..codecs import animation, audio, bundle, chunked, delta, flat, keyframes, manifest, particles, soundbank, tree, wrappers

Rows = Iterable[dict]
#: name -> (schema without the file's path, rows of a file).
TABLES: dict[str, tuple[str, Callable[[bytes], Rows]]] = {}


def table(name: str, schema: str):
    def add(f):
        TABLES[name] = (schema, f)
        return f

    return add


_ENTRY = "ordinal int, path string, path_raw binary, kind string, time struct<kind:string,value:decimal(20,0),date:int,clock:int>, stored_size long, original_size long, offset long, profile string, compression string, layout string, separator string"


def _entries(index: flat.Index) -> list[dict]:
    shared = {"profile": index.profile, "compression": index.compression, "layout": index.layout, "separator": index.separator}
    return [
        {"ordinal": k, "path": e.path.decode("utf-8", "replace"), "path_raw": e.path, "kind": e.kind, "time": e.time | {"value": None if e.time["value"] is None else Decimal(e.time["value"])},
         "stored_size": e.stored_size, "original_size": e.original_size, "offset": e.offset} | shared
        for k, e in enumerate(index.entries)
    ]


@table("flat.entries", _ENTRY)
def _flat_entries(data: bytes) -> Rows:
    return _entries(flat.read_index(data))


@table("flat.files", _ENTRY + ", data binary")
def _flat_files(data: bytes) -> Rows:
    index = flat.read_index(data)
    return (row | {"data": flat.read_entry(data, index, k)} for k, row in enumerate(_entries(index)))


def _of_bundle(read):
    return lambda data: read(data, bundle.read_head(data))


TABLES |= {
    "bundle.packets": ("packet_index int, name string, offset long, length long, pool_index int, ptx_number long, ptx_before long", _of_bundle(bundle.read_packet_table)),
    "bundle.composites": ("name string, is_composite boolean, packets array<struct<packet_index:int,category:array<string>>>", _of_bundle(bundle.read_composites)),
    "bundle.autopools": ("name string, part0_size long, part1_size long", _of_bundle(bundle.read_autopools)),
    "bundle.textures": ("ptx_index int, width int, height int, pitch int, format int, alpha_size int, alpha_format int", _of_bundle(bundle.read_textures)),
    "bundle.file_list": ("path string, pool_index int", _of_bundle(bundle.read_file_list)),
    "bundle.resources": ("`group` string, composite boolean, subgroup string, resolution string, language string, id string, type int, path string, image map<string,string>, properties map<string,string>", _of_bundle(bundle.read_description)),
}
_FILE = "ordinal int, path string, is_part1 boolean, part1 struct<id:long,width:long,height:long>, data binary"


@table("packet.files", _FILE)
def _packet_files(data: bytes) -> Rows:
    return ({"ordinal": k} | f for k, f in enumerate(bundle.unpack_packet(data)))


@table("bundle.files", "packet string, " + _FILE + ", texture struct<ptx_index:int,width:int,height:int,pitch:int,format:int,alpha_size:int,alpha_format:int>")
def _bundle_files(data: bytes) -> Rows:
    return bundle.unpack_bundle(data)


@table("bundle.packet_bytes", "packet_index int, name string, pool_index int, ptx_number long, ptx_before long, data binary")
def _packet_bytes(data: bytes) -> Rows:
    return (p | {"data": bundle.packet_bytes(data, p)} for p in bundle.read_packet_table(data, bundle.read_head(data)))


@table("tree.nodes", "node string, ordinal int, tag string, key string, value string")
def _nodes(data: bytes) -> Rows:
    return (dict(zip(("node", "ordinal", "tag", "key", "value"), n)) for n in tree.nodes(tree.decode(data)))


@table("manifest.groups", "slot_count long, group_index int, kind string, id string, resolution long, parent string")
def _groups(data: bytes) -> Rows:
    m = manifest.decode(data)
    return ({"slot_count": m["slot_count"]} | g for g in manifest.tables(m)["groups"])


@table("manifest.subgroups", "group_index int, ordinal int, id string, resolution long")
def _subgroups(data: bytes) -> Rows:
    return manifest.tables(manifest.decode(data))["subgroups"]


@table("manifest.resources", "group_index int, resource_index int, type string, slot long, id string, path string, width long, height long, x int, y int, ax long, ay long, aw long, ah long, cols long, rows long, atlas boolean, parent string")
def _resources(data: bytes) -> Rows:
    return manifest.tables(manifest.decode(data))["resources"]


@table("keyframes.frames", "layout string, fps float, track int, name string, frame int, x float, y float, kx float, ky float, sx float, sy float, f float, a float, i string, font string, text string")
def _frames(data: bytes) -> Rows:
    found, version = keyframes.decode(data)
    return ({"layout": version, "fps": found["fps"]} | r for r in keyframes.rows(found))


@table("animation.events", "sprite int, frame int, op string, index int, resource long, transform array<double>, color array<double>, name string")
def _events(data: bytes) -> Rows:
    return animation.events(animation.decode(data))


@table("particles.curves", "emitter int, curve string, node int, time float, low float, high float, curve_type int, distribution int")
def _curves(data: bytes) -> Rows:
    return particles.curve_rows(particles.decode(data)[0])


@table("audio.info", "codec string, tag int, channels int, sample_rate long, byte_rate long, block_align int, bits int, big_endian boolean, data_offset long, data_size long, declared_size long, truncated boolean")
def _audio(data: bytes) -> Rows:
    return [audio.inspect(data)]


@table("patch.packets", "name string, before_md5 binary, patch binary")
def _patch(data: bytes) -> Rows:
    return delta.read_patch(data)["packets"]


@table("container.info", "variant string, header_length int, raw_size long, stored_size long, ratio double")
def _container(data: bytes) -> Rows:
    return [wrappers.inspect_container(data)]


@table("bank.chunks", "version int, bank_id long, language long, ordinal int, id string, offset long, size long, data binary")
def _bank_chunks(data: bytes) -> Rows:
    bank = soundbank.read(data, strict=False)
    head = {k: bank[k] for k in ("version", "bank_id", "language")}
    return (head | {"ordinal": k, "size": len(c["data"])} | c for k, c in enumerate(bank["chunks"]))


@table("bank.media", "chunk int, entry int, id long, offset long, size long, data binary")
def _bank_media(data: bytes) -> Rows:
    return soundbank.media(soundbank.read(data))


@table("bank.objects", "version int, chunk int, ordinal int, type_code int, kind string, id long, body binary")
def _bank_objects(data: bytes) -> Rows:
    bank = soundbank.read(data)
    return ({"version": bank["version"]} | o for o in soundbank.objects(bank))


@table("bank.fields", "object_id long, kind string, ordinal int, path string, type string, value string")
def _bank_fields(data: bytes) -> Rows:
    bank = soundbank.read(data)
    return ({"object_id": o["id"], "kind": o["kind"]} | f for o in soundbank.objects(bank) for f in soundbank.fields(bank["version"], o))


#: How the chunks that hold settings are read.
_SECTIONS: dict[str, Callable[[int, bytes], object]] = {
    "STMG": soundbank.settings, "ENVS": soundbank.environments, "INIT": soundbank.plugins, "PLAT": soundbank.platform, "STID": lambda version, raw: soundbank.references(raw),
}


@table("bank.sections", "version int, ordinal int, id string, json string")
def _bank_sections(data: bytes) -> Rows:
    bank = soundbank.read(data)
    return ({"version": bank["version"], "ordinal": k, "id": c["id"], "json": json.dumps(_SECTIONS[c["id"]](bank["version"], c["data"]))} for k, c in enumerate(bank["chunks"]) if c["id"] in _SECTIONS)


_CHUNKED = "ordinal int, path string, size long, chunks array<int>"


@table("chunked.files", _CHUNKED + ", data binary")
def _chunked_files(data: bytes) -> Rows:
    index = chunked.read_index(data)
    return ({"ordinal": k} | f | {"data": raw} for k, (f, raw) in enumerate(zip(index["files"], chunked.read_files([data], index))))


@table("chunked.entries", _CHUNKED)
def _chunked_entries(data: bytes) -> Rows:
    return ({"ordinal": k} | f for k, f in enumerate(chunked.read_index(data)["files"]))


@table("chunked.chunks", "ordinal int, offset long, compressed_length long, decompressed_length long, flags int, volume int, codec string, is_boundary boolean, has_placeholder boolean")
def _chunks(data: bytes) -> Rows:
    return ({"ordinal": k, "codec": chunked.codec_of(c["flags"]), "is_boundary": chunked.is_boundary(c), "has_placeholder": chunked.has_placeholder(c), "volume": c["file"]} | c for k, c in enumerate(chunked.read_index(data)["chunks"]))


#: name -> f(data, **parameters): one value to another.
CODECS: dict[str, Callable[..., bytes | str | None]] = {
    "container.unwrap": wrappers.unwrap_container,
    "container.wrap": wrappers.wrap_container,
    "container.tag": wrappers.md5_tag,
    "xor.wrap": wrappers.xor_wrap,
    "xor.unwrap": wrappers.xor_unwrap,
    "cipher.wrap": wrappers.cipher_wrap,
    "cipher.unwrap": wrappers.cipher_unwrap,
    "text.encode": wrappers.encode_text,
    "text.decode": wrappers.decode_text,
    "tree.to_json": lambda data: tree.to_json(tree.decode(data)),
    "tree.from_json": lambda text, compact=False: (tree.encode_compact if compact else tree.encode)(tree.from_json(text)),
    "manifest.to_json": lambda data: manifest.to_json(manifest.decode(data)),
    "manifest.from_json": lambda text: manifest.encode(_full_manifest(json.loads(text))),
    "keyframes.to_json": lambda data: json.dumps(keyframes.decode(data)[0], ensure_ascii=False, indent=2),
    "keyframes.from_json": lambda text, layout="pc": keyframes.encode(json.loads(text), layout),
    "animation.to_json": lambda data: json.dumps(animation.decode(data), ensure_ascii=False, indent=2),
    "animation.from_json": lambda text: animation.encode(json.loads(text)),
    "particles.to_xml": lambda data: particles.to_xml(particles.decode(data)[0]),
    "particles.from_xml": lambda text, layout="pc": particles.encode(particles.from_xml(text), layout),
    "trail.to_xml": lambda data: particles.trail_to_xml(particles.decode_trail(data)),
    "trail.from_xml": lambda text: particles.encode_trail(particles.trail_from_xml(text)),
    "audio.to_wav": audio.decode,
    "audio.from_wav": lambda data, codec="pcm": audio.encode(data, codec),
    "audio.aac": audio.extract_aac,
    "audio.from_aac": audio.wrap_aac,
}


def _full_manifest(m: dict) -> dict:
    """A manifest read from JSON, with what was left out."""
    for g in m["groups"]:
        g.setdefault("subgroups", [])
        g.setdefault("resources", [])
    return m
