"""Resource bundles: a header, tables of fixed records, a path trie, a description, and packets of files."""

from __future__ import annotations

import zlib

from .binary import Cursor, FormatError, Writer
from .wrappers import inflate, is_zlib

#: Fixed values of the format.
BUNDLE_MAGIC, PACKET_MAGIC = b"1bsr", b"pgsr"
ALIGNMENT = 4096
SHELL = "_CompositeShell"
_HEADER = (
    "information_size", "path_size", "path_offset", "_a", "_b", "packet_list_size", "packet_list_offset", "packet_count", "packet_offset", "packet_size",
    "composite_count", "composite_offset", "composite_size", "composite_list_size", "composite_list_offset", "autopool_count", "autopool_offset", "autopool_size",
    "texture_count", "texture_offset", "texture_size", "part1_offset", "part2_offset", "part3_offset",
)


def aligned(n: int, size: int = ALIGNMENT) -> int:
    return -(-n // size) * size


# path tries: a node is a character and where, in words from the start, the next sibling lies


def read_paths(data: bytes, start: int, length: int, payload) -> list[tuple[str, object]]:
    """(path, payload) in file order; ``payload`` reads what follows a path's end."""
    c, out, text = Cursor(data, start), [], ""
    resume: dict[int, str] = {}
    while c.at < start + length:
        word = c.u32()
        letter, sibling = word & 0xFF, (word >> 8) * 4
        if sibling:
            resume[start + sibling] = text
        if letter:
            text += chr(letter)
        else:
            out.append((text, payload(c)))
            text = resume.pop(c.at, text)
    return out


def write_paths(items: list[tuple[str, object]], put) -> bytes:
    """A trie in order of upper-case path. Each path leaves the longest earlier one that still has an open node where they part, and that node learns where it goes on."""
    w = Writer()
    open_nodes: dict[str, int] = {}
    for path, payload in sorted(items, key=lambda x: x[0].upper()):
        shared = next((n for n in range(len(path), -1, -1) if path[:n] in open_nodes), 0)
        if path[:shared] in open_nodes:
            at = open_nodes.pop(path[:shared])
            w.patch(at, "I", w.out[at] | len(w) // 4 << 8)
        for n in range(shared, len(path) + 1):
            open_nodes[path[:n]] = len(w)
            w.put("I", ord(path[n]) & 0xFF if n < len(path) else 0)
        put(w, payload)
    return w.done()


# packets


def read_packet_head(data: bytes) -> dict:
    c = Cursor(data)
    if c.take(4) != PACKET_MAGIC:
        raise FormatError("not a packet")
    version = c.u32()
    if version not in (3, 4):
        raise FormatError(f"packet version {version}")
    c.take(8)
    flags = c.u32()
    if flags > 3:
        raise FormatError(f"packet flags {flags}")
    names = ("file_offset", "part0_offset", "part0_stored", "part0_size", "_", "part1_offset", "part1_stored", "part1_size")
    head = {"version": version, "flags": flags} | dict(zip(names, c.unpack("8I")))
    c.take(20)
    head["list_size"], head["list_offset"] = c.unpack("2I")
    return head


def _read_file(c: Cursor) -> dict:
    if c.i32() != 1:
        offset, size = c.unpack("2I")
        return {"is_part1": False, "offset": offset, "size": size, "part1": None}
    offset, size, id_, _, _, width, height = c.unpack("7I")
    return {"is_part1": True, "offset": offset, "size": size, "part1": {"id": id_, "width": width, "height": height}}


def list_packet(data: bytes) -> list[dict]:
    """The files of a packet without their bytes: path, is_part1, offset, size, part1."""
    head = read_packet_head(data)
    return [{"path": path} | entry for path, entry in read_paths(data, head["list_offset"], head["list_size"], _read_file)]


def packet_part(data: bytes, head: dict, part: int) -> bytes:
    """One of the two sections. The flags say which are compressed; where they say not, the first bytes decide."""
    size = head[f"part{part}_size"]
    if not size:
        return b""
    raw = Cursor(data, head[f"part{part}_offset"]).take(head[f"part{part}_stored"])
    told = head["flags"] & (1 if part else 2)
    return inflate(raw, size) if told or is_zlib(raw) else raw


def unpack_packet(data: bytes) -> list[dict]:
    """path, is_part1, part1 (id, width, height or None) and data of every file, in list order."""
    head = read_packet_head(data)
    parts = [packet_part(data, head, k) for k in (0, 1)]
    out = []
    for entry in list_packet(data):
        part, end = parts[entry["is_part1"]], entry["offset"] + entry["size"]
        if end > len(part):
            raise FormatError(f"{entry['path']} lies outside its section")
        out.append({"path": entry["path"], "is_part1": entry["is_part1"], "part1": entry["part1"], "data": part[entry["offset"] : end]})
    return out


def pack_packet(files: list[dict], version: int = 4, flags: int = 3) -> bytes:
    """Flag bit 1 compresses the general section, bit 0 the textures; files and compressed sections fill whole 4096-byte pages."""
    if flags > 3:
        raise FormatError(f"packet flags {flags}")
    sections, entries = [bytearray(), bytearray()], []
    for f in files:
        section = sections[bool(f["is_part1"])]
        if f["is_part1"] and not f.get("part1"):
            raise FormatError(f"{f['path']} has no texture record")
        entries.append((f["path"], f | {"offset": len(section), "size": len(f["data"])}))
        section += f["data"] + bytes(aligned(len(f["data"])) - len(f["data"]))

    def put(w: Writer, f: dict) -> None:
        if f["is_part1"]:
            p = f["part1"]
            w.put("i7I", 1, f["offset"], f["size"], p["id"], 0, 0, p["width"], p["height"])
        else:
            w.put("i2I", 0, f["offset"], f["size"])

    listed = write_paths(entries, put)
    w = Writer()
    w.raw(PACKET_MAGIC)
    w.put("IQI", version, 0, flags)
    head = len(w)
    w.raw(bytes(72))
    list_offset = len(w)
    w.raw(listed)
    w.align(ALIGNMENT)
    places = []
    for section, bit in zip(sections, (2, 1)):
        stored = bytes(section)
        if flags & bit and stored:
            stored = zlib.compress(stored, 6)
            stored += bytes(aligned(len(stored)) - len(stored))
        places.append((len(w), len(stored), len(section)))
        w.raw(stored)
    w.patch(head, "8I", places[0][0], *places[0], 0, *places[1])
    w.patch(head + 52, "2I", len(listed), list_offset)
    return w.done()


# bundles


def read_head(data: bytes) -> dict:
    c = Cursor(data)
    if c.take(4) != BUNDLE_MAGIC:
        raise FormatError("not a bundle")
    head = {"version": c.u32()}
    c.u32()
    head |= dict(zip(_HEADER, c.unpack(f"{len(_HEADER)}I")))
    head["information_without_manifest_size"] = c.u32() if head["version"] >= 4 else 0
    return head


def metadata_size(head: dict, with_manifest: bool = True) -> int:
    return head["information_without_manifest_size"] if not with_manifest and head["version"] >= 4 else head["information_size"]


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").strip("\0")


def _c_text(data: bytes, at: int) -> str:
    return Cursor(data, at).c_string().decode("utf-8", "replace")


def read_file_list(data: bytes, head: dict) -> list[dict]:
    return [{"path": p, "pool_index": i} for p, i in read_paths(data, head["path_offset"], head["path_size"], Cursor.i32)]


def read_packet_table(data: bytes, head: dict) -> list[dict]:
    out = []
    for k in range(head["packet_count"]):
        at = head["packet_offset"] + k * head["packet_size"]
        c = Cursor(data, at)
        name = _text(c.take(128))
        offset, length, pool = c.unpack("2Ii")
        number, before = Cursor(data, at + head["packet_size"] - 8).unpack("2I")
        out.append({"packet_index": k, "name": name, "offset": offset, "length": length, "pool_index": pool, "ptx_number": number, "ptx_before": before})
    return out


def read_composites(data: bytes, head: dict) -> list[dict]:
    out = []
    for k in range(head["composite_count"]):
        at = head["composite_offset"] + k * head["composite_size"]
        whole = _c_text(data, at)
        n = Cursor(data, at + head["composite_size"] - 4).u32()
        c, packets = Cursor(data, at + 128), []
        for _ in range(n):
            index, category = c.unpack("2i")
            locale = _text(c.take(4))
            c.take(4)
            packets.append({"packet_index": index, "category": [str(category), locale]})
        out.append({"name": whole.replace(SHELL, ""), "is_composite": not whole.endswith(SHELL), "packets": packets})
    return out


def read_autopools(data: bytes, head: dict) -> list[dict]:
    out = []
    for k in range(head["autopool_count"]):
        at = head["autopool_offset"] + k * head["autopool_size"]
        part0, part1 = Cursor(data, at + 128).unpack("2I")
        out.append({"name": _c_text(data, at), "part0_size": part0, "part1_size": part1})
    return out


def read_textures(data: bytes, head: dict) -> list[dict]:
    size, out, c = head["texture_size"], [], Cursor(data, head["texture_offset"])
    for k in range(head["texture_count"]):
        row = {"ptx_index": k} | dict(zip(("width", "height", "pitch", "format"), c.unpack("4i"))) | {"alpha_size": None, "alpha_format": None}
        if size >= 0x14:
            row["alpha_size"] = c.i32()
            if size == 0x18:
                row["alpha_format"] = c.i32()
        out.append(row)
    return out


_IMAGE = ("imagetype", "aflags", "x", "y", "ax", "ay", "aw", "ah", "rows", "cols")


def read_description(data: bytes, head: dict) -> list[dict]:
    """A row for each resource: group, composite, subgroup, resolution, language, id, type, path, image (or None), properties."""
    one, two, three = head["part1_offset"], head["part2_offset"], head["part3_offset"]
    c, out = Cursor(data, one), []
    while c.at < two:
        group, subgroups = _c_text(data, three + c.u32()), c.u32()
        c.u32()
        for _ in range(subgroups):
            resolution = c.u32()
            language = _text(c.take(4))
            name, n = _c_text(data, three + c.u32()), c.u32()
            for place in (c.u32() for _ in range(n)):
                r = Cursor(data, two + place)
                r.u32()
                kind, _ = r.unpack("2H")
                image_end, image_begin, id_at, path_at, properties = r.unpack("5I")
                image = None
                if image_end and image_begin:
                    image = dict(zip(_IMAGE, map(str, r.unpack("10H"))))
                    image["parent"] = _c_text(data, three + r.u32())
                held = {}
                for _ in range(properties):
                    key, _, value = r.unpack("3I")
                    held[_c_text(data, three + key)] = _c_text(data, three + value)
                out.append({"group": group, "composite": not group.endswith(SHELL), "subgroup": name, "resolution": str(resolution), "language": language,
                            "id": _c_text(data, three + id_at), "type": kind, "path": _c_text(data, three + path_at), "image": image, "properties": held})
    return out


def packet_bytes(data: bytes, packet: dict) -> bytes:
    return Cursor(data, packet["offset"]).take(packet["length"]) if packet["length"] else b""


def archive_end(packets: list[dict]) -> int:
    return max((p["offset"] + p["length"] for p in packets), default=0)


def unpack_bundle(data: bytes) -> list[dict]:
    """Every file: packet, ordinal, path, is_part1, part1, data, and for textures the record of the table that its place in the packet points to."""
    head = read_head(data)
    textures, out = read_textures(data, head), []
    for packet in read_packet_table(data, head):
        raw = packet_bytes(data, packet)
        if not raw:
            continue
        nth = 0
        for ordinal, f in enumerate(unpack_packet(raw)):
            row = f | {"packet": packet["name"], "ordinal": ordinal, "texture": None}
            if f["is_part1"]:
                at = packet["ptx_before"] + nth
                if (not packet["ptx_number"] or nth < packet["ptx_number"]) and at < len(textures):
                    row["texture"] = textures[at]
                nth += 1
            out.append(row)
    return out


def build_bundle(packets: list[dict], textures: list[dict], composites: list[dict], autopools: list[dict], file_list: list[dict], description: list[dict] | None = None, version: int = 4, texture_size: int = 0x10) -> bytes:
    """A bundle of tables and packets (name, data, pool_index, ptx_number, ptx_before). Packets begin at 4096-byte pages."""
    w = Writer()
    w.raw(BUNDLE_MAGIC)
    w.put("2I", version, 0)
    head = dict.fromkeys(_HEADER, 0)
    w.raw(bytes(4 * len(_HEADER) + (4 if version >= 4 else 0)))

    head["path_offset"] = len(w)
    w.raw(write_paths([(f["path"], f["pool_index"]) for f in file_list], lambda w, i: w.put("i", i)))
    head["path_size"] = len(w) - head["path_offset"]

    def names(kind: str, items: list[dict], pointer: str) -> None:
        head[f"{kind}_list_offset"] = len(w)
        w.raw(write_paths([(x["name"].upper(), i) for i, x in enumerate(items)], lambda w, i: w.put("i", i)))
        head[f"{kind}_list_size"] = len(w) - head[f"{kind}_list_offset"]

    names("packet", packets, "packet")
    head["packet_count"], head["packet_offset"], head["packet_size"] = len(packets), len(w), 204
    w.raw(bytes(204 * len(packets)))
    head["composite_count"], head["composite_offset"], head["composite_size"] = len(composites), len(w), 1156
    for x in composites:
        at = len(w)
        w.raw(bytes(1156))
        raw = (x["name"] + ("" if x["is_composite"] else SHELL)).encode()
        if len(raw) > 127 or len(x["packets"]) > 64:
            raise FormatError("a composite is too large")
        w.out[at : at + len(raw)] = raw
        for k, p in enumerate(x["packets"]):
            w.patch(at + 128 + 16 * k, "2i4s", p["packet_index"], int(p["category"][0]), p["category"][1].encode()[:4])
        w.patch(at + 1152, "I", len(x["packets"]))
    names("composite", composites, "composite")
    head["autopool_count"], head["autopool_offset"], head["autopool_size"] = len(autopools), len(w), 152
    for x in autopools:
        at = len(w)
        w.raw(bytes(152))
        raw = x["name"].encode()
        w.out[at : at + len(raw)] = raw
        w.patch(at + 128, "3I", x["part0_size"], x["part1_size"], 1)
    head["texture_count"], head["texture_offset"], head["texture_size"] = len(textures), len(w), texture_size
    for x in textures:
        w.put("4i", x["width"], x["height"], x["pitch"], x["format"])
        if texture_size >= 0x14:
            w.put("i", x["alpha_size"] or 0)
        if texture_size == 0x18:
            w.put("i", x["alpha_format"] or 0)
    without = aligned(len(w))
    if description:
        _write_description(w, head, description)
    w.align(ALIGNMENT)
    head["information_size"] = len(w)
    for k, p in enumerate(packets):
        at = head["packet_offset"] + 204 * k
        raw = p["name"].encode()
        if len(raw) > 127:
            raise FormatError("a packet's name is too long")
        w.out[at : at + len(raw)] = raw
        w.patch(at + 128, "2Ii", len(w), len(p["data"]), p["pool_index"])
        w.out[at + 140 : at + 172] = p["data"][16:48].ljust(32, b"\0")
        w.patch(at + 196, "2I", p["ptx_number"], p["ptx_before"])
        w.raw(p["data"])
        w.align(ALIGNMENT)
    w.patch(12, f"{len(_HEADER)}I", *(head[k] for k in _HEADER))
    if version >= 4:
        w.patch(12 + 4 * len(_HEADER), "I", without)
    return w.done()


def _write_description(w: Writer, head: dict, rows: list[dict]) -> None:
    """Groups, resources and strings; keys in order, every string once."""
    texts, strings = {"": 0}, bytearray(b"\0")

    def text(x: str) -> int:
        if x not in texts:
            texts[x] = len(strings)
            strings.extend(x.encode() + b"\0")
        return texts[x]

    one, two = Writer(), Writer()
    groups: dict[str, dict[str, list[dict]]] = {}
    for r in rows:
        groups.setdefault(r["group"], {}).setdefault(r["subgroup"], []).append(r)
    for group, subgroups in sorted(groups.items()):
        one.put("3I", text(group), len(subgroups), 0x10)
        for subgroup, members in sorted(subgroups.items()):
            one.put("I4s2I", int(members[0]["resolution"]), members[0]["language"].encode()[:4], text(subgroup), len(members))
            for r in sorted(members, key=lambda r: r["id"]):
                one.put("I", len(two))
                at, image = len(two), r["image"]
                begin = 0x20 if image else 0
                end = begin + 24 if image else 0
                two.put("I2H5I", 0, r["type"], 0x1C, end, begin, text(r["id"]), text(r["path"]), len(r["properties"]))
                if image:
                    two.put("10HI", *(int(image[k]) for k in _IMAGE), text(image["parent"]))
                for k, v in sorted(r["properties"].items()):
                    two.put("3I", text(k), 0, text(v))
                del at
    head["part1_offset"] = len(w)
    w.raw(one.done())
    head["part2_offset"] = len(w)
    w.raw(two.done())
    head["part3_offset"] = len(w)
    w.raw(bytes(strings))
