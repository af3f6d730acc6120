"""Sound banks: a header, chunks in order, an index of media in the data chunk, and a hierarchy of typed objects."""

from __future__ import annotations

import struct

from .binary import Cursor, FormatError, Writer

#: The versions, and kinds by code. From 128 on codes above 15 moved.
VERSIONS = (72, 88, 112, 113, 118, 120, 125, 128, 132, 134, 135, 140, 145, 150)
_KINDS = {
    1: "StatefulPropertySetting", 2: "Sound", 3: "EventAction", 4: "Event", 5: "SoundPlaylistContainer", 6: "SoundSwitchContainer", 7: "ActorMixer", 8: "AudioBus", 9: "SoundBlendContainer",
    10: "MusicSegment", 11: "MusicTrack", 12: "MusicSwitchContainer", 13: "MusicPlaylistContainer", 14: "Attenuation", 15: "DialogueEvent",
}
_EARLY = {18: "Effect", 19: "Source", 20: "AuxiliaryAudioBus"}
_EARLY_112 = {21: "LowFrequencyOscillatorModulator", 22: "EnvelopeModulator"}
_LATE = {16: "Effect", 17: "Source", 18: "AuxiliaryAudioBus", 19: "LowFrequencyOscillatorModulator", 20: "EnvelopeModulator", 21: "AudioDevice"}
#: The reserved media entry: no payload, an offset of 1.
RESERVED = (0, 1, 0)
LIMIT_CHUNKS, LIMIT_ENTRIES = 4096, 1_000_000
_FORMS = {"u8": "B", "u16": "H", "u32": "I", "f32": "f"}
_WIDTHS = {k: struct.calcsize(v) for k, v in _FORMS.items()}


def kind_of(version: int, code: int) -> str:
    if code in _KINDS:
        return _KINDS[code]
    if version < 128:
        return _EARLY.get(code) or (_EARLY_112.get(code) if version >= 112 else None) or "Unknown"
    return _LATE.get(code) or ("TimeModulator" if code == 22 and version >= 132 else "Unknown")


def code_of(version: int, kind: str) -> int | None:
    return next((c for c in range(256) if kind != "Unknown" and kind_of(version, c) == kind), None)


def read(data: bytes, strict: bool = True) -> dict:
    """version, id, language, expand (the header's rest) and chunks (id, offset, data), without looking into chunks."""
    c = Cursor(data)
    if c.take(4) != b"BKHD":
        raise FormatError("not a sound bank")
    head = Cursor(c.take(c.u32()))
    version, id_, language = head.unpack("3I")
    if strict and version not in VERSIONS:
        raise FormatError(f"bank version {version}")
    chunks = []
    while c.left:
        if len(chunks) == LIMIT_CHUNKS:
            raise FormatError("too many chunks")
        name, size = c.take(4), c.u32()
        chunks.append({"id": name.decode("latin-1"), "offset": c.at, "data": c.take(size)})
    bank = {"version": version, "bank_id": id_, "language": language, "expand": head.take(head.left), "chunks": chunks}
    if strict:
        check_pairs(bank)
    return bank


def media_index(raw: bytes) -> list[tuple[int, int, int]]:
    """(id, offset, size) of each entry."""
    if len(raw) % 12 or len(raw) // 12 > LIMIT_ENTRIES:
        raise FormatError(f"an index of {len(raw)} bytes")
    return list(struct.iter_unpack("<3I", raw))


def check_pairs(bank: dict) -> None:
    """Every index is followed by its data, and every entry lies in them."""
    chunks = bank["chunks"]
    for k, chunk in enumerate(chunks):
        if chunk["id"] != "DIDX":
            continue
        if k + 1 == len(chunks) or chunks[k + 1]["id"] != "DATA":
            raise FormatError("an index without data behind it")
        for id_, offset, size in media_index(chunk["data"]):
            if id_ == 0 and (id_, offset, size) != RESERVED:
                raise FormatError("entry 0 has an offset of 1 and no bytes")
            if id_ and offset + size > len(chunks[k + 1]["data"]):
                raise FormatError(f"media {id_} lies outside the data")


def media(bank: dict) -> list[dict]:
    """(chunk, entry, id, offset, size, data) of every index; of entries with one id a look-up takes the first."""
    out = []
    for k, chunk in enumerate(bank["chunks"]):
        if chunk["id"] == "DIDX":
            body = bank["chunks"][k + 1]["data"] if k + 1 < len(bank["chunks"]) else b""
            for n, (id_, offset, size) in enumerate(media_index(chunk["data"])):
                out.append({"chunk": k, "entry": n, "id": id_, "offset": offset, "size": size, "data": b"" if (id_, offset, size) == RESERVED else body[offset : offset + size]})
    return out


def build_media(items: list[tuple[int, bytes]], alignment: int = 16) -> tuple[bytes, bytes]:
    """Index and data: each payload begins at a multiple of the alignment; the reserved id 0 takes no room."""
    if alignment < 1 or alignment & (alignment - 1):
        raise FormatError("alignments are powers of two")
    index, body = Writer(), Writer()
    for id_, payload in items:
        if id_ == 0:
            if payload:
                raise FormatError("entry 0 has no bytes")
            index.put("3I", *RESERVED)
            continue
        body.align(alignment)
        index.put("3I", id_, len(body), len(payload))
        body.raw(payload)
    return index.done(), body.done()


def with_media(bank: dict, items: list[tuple[int, bytes]], alignment: int = 16) -> dict:
    """The bank with its first index and data replaced, or put in front."""
    index, body = ({"id": n, "offset": 0, "data": d} for n, d in zip(("DIDX", "DATA"), build_media(items, alignment)))
    chunks = list(bank["chunks"])
    at = next((k for k, c in enumerate(chunks) if c["id"] == "DIDX"), None)
    if at is None:
        chunks[:0] = [index, body]
    else:
        chunks[at : at + 1 + (at + 1 < len(chunks) and chunks[at + 1]["id"] == "DATA")] = [index, body]
    return bank | {"chunks": chunks}


def replace_media(bank: dict, chunk: int, entry: int, payload: bytes, alignment: int = 16) -> dict:
    """The bank with one entry's payload replaced; the others move as the alignment asks."""
    own = [m for m in media(bank) if m["chunk"] == chunk]
    if entry >= len(own):
        raise FormatError("no such entry")
    index, body = build_media([(m["id"], payload if m["entry"] == entry else m["data"]) for m in own], alignment)
    chunks = [c | {"data": index} if k == chunk else c | {"data": body} if k == chunk + 1 else c for k, c in enumerate(bank["chunks"])]
    return bank | {"chunks": chunks}


def objects(bank: dict) -> list[dict]:
    """(chunk, ordinal, type_code, kind, id, body) of the hierarchy."""
    out = []
    for k, chunk in enumerate(bank["chunks"]):
        if chunk["id"] != "HIRC":
            continue
        c = Cursor(chunk["data"])
        n = c.u32()
        if n > LIMIT_ENTRIES:
            raise FormatError("too many objects")
        for ordinal in range(n):
            code, size = c.u8(), c.u32()
            if size < 4:
                raise FormatError("an object shorter than its id")
            out.append({"chunk": k, "ordinal": ordinal, "type_code": code, "kind": kind_of(bank["version"], code), "id": c.u32(), "body": c.take(size - 4)})
        if c.left:
            raise FormatError(f"{c.left} bytes after the objects")
    return out


def fields(version: int, row: dict) -> list[dict]:
    """(ordinal, path, type, value, offset) of an object's body, for the kinds whose layout is the same within a version range; an opaque field for all others."""
    c, out = Cursor(row["body"]), []

    def add(path: str, kind: str, value, offset: int | None = None) -> None:
        at = c.at - _WIDTHS[kind] if offset is None and kind in _WIDTHS else offset
        out.append({"ordinal": len(out), "path": path, "type": kind, "value": value if isinstance(value, str) else repr(value), "offset": at})

    if row["kind"] == "Event":
        n = c.u32() if version < 125 else c.u8()
        add("action_count", "u32" if version < 125 else "u8", n)
        for k in range(n):
            add(f"actions[{k}]", "u32", c.u32())
    elif row["kind"] == "StatefulPropertySetting":
        n = c.u8() if version < 128 else c.u16()
        first, width = c.at, 1 if version < 128 else 2
        kinds = [c.u8() if version < 128 else c.u16() for _ in range(n)]
        for k, kind in enumerate(kinds):
            add(f"values[{k}].type", "u8" if version < 128 else "u16", kind, first + k * width)
            add(f"values[{k}].value", "f32", c.f32())
    elif row["kind"] == "EventAction":
        packed = c.u8()
        add("scope_and_mode", "u8", packed)
        if packed >> 1 & (7 if version < 125 else 3) not in ((0, 1, 2, 4) if version < 125 else (0, 1, 2)):
            raise FormatError(f"an action's mode in {packed:#x}")
        for name, kind, form in (("action_type", "u8", "B"), ("target", "u32", "I"), ("u1", "u8", "B")):
            add(name, kind, c.unpack(form))
        start = c.at
        add("payload", "opaque", c.take(c.left).hex(), start)
    else:
        add("body", "opaque", row["body"].hex(), 0)
        return out
    if c.left:
        raise FormatError(f"{c.left} bytes after a body")
    return out


def replace_field(version: int, row: dict, path: str, value) -> tuple[dict, str]:
    """(the object with one field's value replaced, the value it had). A field keeps its type and its bytes their number, so whatever follows stays where it is."""
    found = next((f for f in fields(version, row) if f["path"] == path), None)
    if found is None:
        raise FormatError(f"no field {path}")
    if path.endswith("_count"):
        raise FormatError(f"{path} is what the list has")
    kind, at = found["type"], found["offset"]
    if kind == "opaque":
        raw = value if isinstance(value, bytes) else None
        if raw is None or len(raw) != len(found["value"]) // 2:
            raise FormatError(f"{path} has {len(found['value']) // 2} bytes")
    else:
        if isinstance(value, bool) or not isinstance(value, float if kind == "f32" else int):
            raise FormatError(f"{path} is of type {kind}")
        try:
            raw = struct.pack("<" + _FORMS[kind], value)
        except (struct.error, OverflowError) as error:
            raise FormatError(f"{path}: {value} is no {kind}") from error
    body = row["body"][:at] + raw + row["body"][at + len(raw) :]
    out = row | {"body": body}
    fields(version, out)  # an action's mode may not be what its version knows
    return out, found["value"]


def copy_media(data, id_: int, out, block: int = 64 << 10) -> bool:
    """Streams the first media entry of an id from an open bank file to an open output, ``block`` bytes at a time; whether there is one."""
    data.seek(0)
    index: list[tuple[int, int, int]] = []
    while head := data.read(8):
        if len(head) < 8:
            raise FormatError("a chunk's head is cut off")
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        at = data.tell()
        if name == b"DIDX":
            index = media_index(data.read(size))
        elif name == b"DATA" and (entry := next((e for e in index if e[0] == id_ and e != RESERVED), None)):
            _, offset, left = entry
            if offset + left > size:
                raise FormatError(f"media {id_} lies outside the data")
            data.seek(at + offset)
            while left:
                part = data.read(min(block, left))
                if not part:
                    raise FormatError("the data is cut off")
                out.write(part)
                left -= len(part)
            return True
        data.seek(at + size)
    return False


# chunks of settings, by tables: (name, form, since, until) for a value, (name, count's form, fields, since, until) for a list

_ALL = (0, 1 << 31)
_CURVE = (("x", "f", *_ALL), ("y", "f", *_ALL), ("curve", "I", *_ALL))
_ENVIRONMENT = (("enabled", "B", *_ALL), ("mode", "B", *_ALL), ("points", "H", _CURVE, *_ALL))
_SETTINGS = (
    ("voice_filter_behavior", "H", 145, _ALL[1]),
    ("volume_threshold", "f", *_ALL),
    ("maximum_voice_instances", "H", *_ALL),
    ("compatibility_value", "H", 128, _ALL[1]),
    ("state_groups", "I", (("id", "I", *_ALL), ("default_transition_time", "I", *_ALL), ("custom_transitions", "I", (("from", "I", *_ALL), ("to", "I", *_ALL), ("time", "I", *_ALL)), *_ALL)), *_ALL),
    ("switch_groups", "I", (("id", "I", *_ALL), ("parameter", "I", *_ALL), ("parameter_category", "B", 112, _ALL[1]), ("points", "I", (("x", "f", *_ALL), ("y", "I", *_ALL), ("curve", "I", *_ALL)), *_ALL)), *_ALL),
    ("game_parameters", "I", (("id", "I", *_ALL), ("default", "f", *_ALL), ("mode", "I", 112, _ALL[1]), ("attack", "f", 112, _ALL[1]), ("release", "f", 112, _ALL[1]), ("built_in", "B", 112, _ALL[1])), *_ALL),
    ("reserved_1", "I", 120, 140),
    ("reserved_2", "I", 120, 125),
    ("u1", "I", (("id", "I", *_ALL), *((f"u{k}", "f", *_ALL) for k in range(1, 7))), 140, _ALL[1]),
)


def _record(c: Cursor, version: int, spec: tuple) -> dict:
    out: dict = {}
    for entry in spec:
        since, until = entry[-2:]
        if not since <= version < until:
            continue
        value = c.unpack(entry[1])
        if len(entry) == 5:
            if value > LIMIT_ENTRIES:
                raise FormatError(f"{entry[0]}: too many")
            value = [_record(c, version, entry[2]) for _ in range(value)]
        elif entry[0].startswith("reserved") and value:
            raise FormatError(f"{entry[0]} is {value}")
        out[entry[0]] = value
    return out


def _whole(raw: bytes, version: int, spec: tuple) -> dict:
    c = Cursor(raw)
    out = _record(c, version, spec)
    if c.left:
        raise FormatError(f"{c.left} bytes after the settings")
    return out


def settings(version: int, raw: bytes) -> dict:
    """State groups, switch groups, game parameters and limits of the settings chunk."""
    return _whole(raw, version, _SETTINGS)


def environments(version: int, raw: bytes) -> dict:
    """Curves of obstruction and occlusion: volume, low-pass and, from version 112 on, high-pass."""
    c, out = Cursor(raw), {}
    for kind in ("obstruction", "occlusion"):
        for curve in ("volume", "low_pass", "high_pass")[: 3 if version >= 112 else 2]:
            found = _record(c, version, _ENVIRONMENT)
            if found["enabled"] > 1:
                raise FormatError(f"{kind}.{curve}: enabled is {found['enabled']}")
            out[f"{kind}.{curve}"] = found
    if c.left:
        raise FormatError(f"{c.left} bytes after the curves")
    return out


def plugins(version: int, raw: bytes) -> list[dict]:
    """(id, library) of the plug-ins; there are none before version 118."""
    if version < 118:
        raise FormatError(f"version {version} has no plug-ins")
    c, out = Cursor(raw), []
    for _ in range(c.u32()):
        id_ = c.u32()
        if version >= 140:
            library = c.c_string()
        else:
            library = c.take(c.u32())
            if not library.endswith(b"\0"):
                raise FormatError("a library's name does not end in a nul")
            library = library[:-1]
        out.append({"id": id_, "library": library.decode("utf-8", "replace")})
    if c.left:
        raise FormatError(f"{c.left} bytes after the plug-ins")
    return out


def references(raw: bytes) -> list[dict]:
    """(id, name) of the banks that a reference chunk names."""
    c = Cursor(raw)
    if c.u32() != 1:
        raise FormatError("a reference chunk begins with 1")
    return [{"id": c.u32(), "name": c.take(c.u8()).decode("utf-8", "replace")} for _ in range(c.u32())]


def platform(version: int, raw: bytes) -> str:
    """The platform's name: counted, counted with a nul, or ended by one, by version."""
    c = Cursor(raw)
    if version >= 140:
        return c.c_string().decode("utf-8", "replace")
    text = c.take(c.u32())
    return (text[:-1] if version >= 118 else text).decode("utf-8", "replace")


def write(bank: dict) -> bytes:
    w = Writer()
    w.raw(b"BKHD")
    w.put("4I", 12 + len(bank["expand"]), bank["version"], bank["bank_id"], bank["language"])
    w.raw(bank["expand"])
    for chunk in bank["chunks"]:
        w.raw(chunk["id"].encode("latin-1"))
        w.put("I", len(chunk["data"]))
        w.raw(chunk["data"])
    return w.done()


def write_objects(version: int, rows: list[tuple[str, int, bytes]]) -> bytes:
    """A hierarchy chunk of (kind, id, body)."""
    w = Writer()
    w.put("I", len(rows))
    for kind, id_, body in rows:
        code = code_of(version, kind)
        if code is None:
            raise FormatError(f"version {version} has no {kind}")
        w.put("B2I", code, 4 + len(body), id_)
        w.raw(body)
    return w.done()
