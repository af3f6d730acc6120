"""The tagged tree format: an ordered, schema-less document with typed scalars.

A value is (tag, payload): the tag keeps the exact type, which JSON would lose.

    null, bool, i8 u8 i16 u16 i32 u32 i64 u64, vi32 vu32 vi64 vu64 (variable
    length), f32, f64, str, bin, rtid, array (list of values), object (list of
    (key, value): order and repeated keys stay)
"""

from __future__ import annotations

import json
import re
import struct

from .binary import Cursor, FormatError, Writer, varint_size, zigzag_of

Value = tuple[str, object]

#: File marks, versions and tags.
HEADER, FOOTER = b"RTON", b"DONE"
STANDARD, COMPACT = 1, 0x00010001
_FIXED = {0x08: ("i8", "b"), 0x0A: ("u8", "B"), 0x10: ("i16", "h"), 0x12: ("u16", "H"), 0x20: ("i32", "i"), 0x26: ("u32", "I"), 0x40: ("i64", "q"), 0x46: ("u64", "Q"), 0x22: ("f32", "f"), 0x42: ("f64", "d")}
_ZERO = {0x09: ("i8", 0), 0x0B: ("u8", 0), 0x11: ("i16", 0), 0x13: ("u16", 0), 0x21: ("i32", 0), 0x27: ("u32", 0), 0x41: ("i64", 0), 0x47: ("u64", 0), 0x23: ("f32", 0.0), 0x43: ("f64", 0.0)}
_TAG_OF = {name: tag for tag, (name, _) in _FIXED.items()}
_FORM_OF = dict(_FIXED.values())
_ZERO_OF = {name: tag for tag, (name, _) in _ZERO.items()}

NULL: Value = ("null", None)
_UNKNOWN_BLOB = '$BINARY("<unknown>", {})'


# typed ids

_HEX_UID = re.compile(r"([0-9a-f]+)\.([0-9a-f]+)\.([0-9a-f]+)@(.*)", re.S)
_RUN_UID = re.compile(r"(\d+)\.(\d+)\.([0-9a-fA-F]+)@(.*)", re.S)
_RUN_OBJ = re.compile(r":(\d+)\.(\d+)@(\d+)")
_RUN_SHORT = re.compile(r":(\d+)\.(\d+)")
_RAW = re.compile(r"([^@]+)@([^@]*)")


def _uid(id_: int, group: int, obj: int, name: str | None) -> dict:
    if id_ >= 1 << 64 or group >= 1 << 64 or obj >= 1 << 32:
        raise FormatError("a typed id is out of range")
    return {"kind": "uid", "group": group, "id": id_, "obj": obj, "name": name or None, "parent": None}


def parse_rtid(text: str, runtime: bool = False) -> dict:
    """``RTID(...)`` as kind (null, uid, raw), group, id, obj, name, parent. The file dialect has hexadecimal numbers, the run-time one decimal ones."""
    if not (text.startswith("RTID(") and text.endswith(")")):
        raise FormatError("not a typed id")
    inner = text[5:-1]
    if inner == "0":
        return {"kind": "null", "group": None, "id": None, "obj": None, "name": None, "parent": None}
    if m := (_RUN_UID if runtime else _HEX_UID).fullmatch(inner):
        base = 10 if runtime else 16
        return _uid(int(m[1], base), int(m[2], base), int(m[3], 16), m[4])
    if m := _RUN_OBJ.fullmatch(inner):
        return _uid(int(m[1]), int(m[2]), int(m[3]), None)
    if m := _RUN_SHORT.fullmatch(inner):
        return _uid(int(m[1]), int(m[2]), 0, None)
    if m := _RAW.fullmatch(inner):
        return {"kind": "raw", "group": None, "id": None, "obj": None, "name": m[1], "parent": m[2]}
    raise FormatError("the typed id's content is not understood")


def format_rtid(r: dict, runtime: bool = False) -> str:
    if r["kind"] == "null":
        return "RTID(0)"
    if r["kind"] == "raw":
        return f"RTID({r['name']}@{r['parent']})"
    id_, group, obj, name = r["id"], r["group"], r["obj"], r["name"]
    if not runtime:
        return f"RTID({id_:x}.{group:x}.{obj:08x}@{name or ''})"
    if name:
        return f"RTID({id_}.{group}.{obj:08x}@{name})"
    return f"RTID(:{id_}.{group}@{obj})" if obj else f"RTID(:{id_}.{group})"


# reading


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.c = Cursor(data)
        self.latin: list[str] = []
        self.utf8: list[str] = []
        self.by_place: dict[tuple[int, int], str] = {}

    def latin_text(self) -> str:
        return self.c.take(self.c.varint()).decode("latin-1")

    def utf8_text(self) -> str:
        """The count of characters rules; the byte length that follows it is not trusted."""
        count = self.c.varint()
        self.c.varint()
        begin = self.c.at
        for _ in range(count):
            b = self.c.u8()
            width = 1 if b < 0x80 else 2 if b & 0xE0 == 0xC0 else 3 if b & 0xF0 == 0xE0 else 4 if b & 0xF8 == 0xF0 else 0
            if not width:
                raise FormatError("no character begins with this byte")
            self.c.take(width - 1)
        try:
            return self.c.data[begin : self.c.at].decode("utf-8")
        except UnicodeDecodeError as error:
            raise FormatError(str(error)) from error

    def known(self, held: list[str]) -> str:
        at = self.c.varint()
        if at >= len(held):
            raise FormatError("a string is referred to before it is defined")
        return held[at]

    def compact_text(self, tag: int) -> str:
        """0xB0 to 0xB7: Latin-1 or UTF-32, definition or reference by place, and for keys with the value's place behind."""
        wide, refers, paired = tag & 2, tag & 1, tag & 4
        kind = 1 if wide else 0
        if refers:
            key = (kind, self.c.u32())
            if key not in self.by_place:
                raise FormatError("a string is referred to before it is defined")
            text = self.by_place[key]
        else:
            size = self.c.u32()
            if wide and size % 4:
                raise FormatError("a UTF-32 string of an odd size")
            place, raw = self.c.at, self.c.take(size)
            if wide:
                try:
                    text = raw.decode("utf-32-le").partition("\0")[0]
                except UnicodeDecodeError as error:
                    raise FormatError(str(error)) from error
            else:
                text = (raw[:-1] if raw.endswith(b"\0") else raw).decode("latin-1")
            self.by_place[kind, place] = text
        if paired:
            self.c.u32()
        return text

    def rtid(self) -> Value:
        kind = self.c.u8()
        if kind == 0:
            return NULL
        if kind in (1, 2):
            name = self.utf8_text() if kind == 2 else None
            group, id_, obj = self.c.varint(), self.c.varint(), self.c.u32()
            return "rtid", _uid(id_, group, obj, name)
        if kind == 3:
            name, parent = self.utf8_text(), self.utf8_text()
            return "rtid", {"kind": "raw", "group": None, "id": None, "obj": None, "name": name, "parent": parent}
        raise FormatError(f"no typed id has the kind {kind}")

    def value(self) -> Value:
        c, tag = self.c, self.c.u8()
        if tag in _FIXED:
            name, form = _FIXED[tag]
            return name, c.unpack(form)
        if tag in _ZERO:
            return _ZERO[tag]
        if tag in (0, 1):
            return "bool", bool(tag)
        if tag == 0x02:
            return "str", "*"
        if tag in (0x24, 0x44):  # unsigned on the wire; signed where it fits
            bits = 32 if tag == 0x24 else 64
            n = c.varint(bits)
            return ("i" if n < 1 << (bits - 1) else "u") + str(bits), n
        if tag in (0x28, 0x48):
            bits = 32 if tag == 0x28 else 64
            return f"u{bits}", c.varint(bits)
        if tag in (0x25, 0x45):
            bits = 32 if tag == 0x25 else 64
            return f"i{bits}", c.zigzag(bits)
        if tag in (0x81, 0x90):
            text = self.latin_text()
            if tag == 0x90:
                self.latin.append(text)
            return "str", text
        if tag in (0x82, 0x92):
            text = self.utf8_text()
            if tag == 0x92:
                self.utf8.append(text)
            return "str", text
        if tag == 0x91:
            return "str", self.known(self.latin)
        if tag == 0x93:
            return "str", self.known(self.utf8)
        if tag == 0x87:
            c.u8()
            digits = self.latin_text()
            c.take(c.varint())
            return "bin", _from_hex(digits)
        if tag in (0x83, 0xBA):
            return self.rtid()
        if tag == 0x84:
            return NULL
        if tag == 0x86:
            self.capacity()
            return "array", self.elements(c.varint())
        if tag in (0x85, 0xB8):
            return "object", self.entries()
        if tag == 0xB9:
            self.capacity()
            return "array", self.compact_elements(c.u32())
        if tag == 0xBB:
            kind = c.u8()
            digits = self.compact_text(kind) if kind in (0xB0, 0xB1) else None
            size = c.u32()
            c.take(size)
            return ("str", _UNKNOWN_BLOB.format(size)) if digits is None else ("bin", _from_hex(digits))
        if tag == 0xBC:
            return "bool", c.u8() != 0
        if 0xB0 <= tag <= 0xB7:
            return "str", self.compact_text(tag)
        raise FormatError(f"no value has the tag {tag:#x}")

    def capacity(self) -> None:
        if self.c.u8() != 0xFD:
            raise FormatError("an array without its capacity")

    def elements(self, most: int) -> list[Value]:
        out: list[Value] = []
        while self.c.take(1) != b"\xfe":
            if len(out) == most:
                raise FormatError("an array above its capacity")
            self.c.at -= 1
            out.append(self.value())
        return out

    def compact_elements(self, n: int) -> list[Value]:
        places = [self.c.u32() for _ in range(min(n + 1, self.c.left // 4 + 1))]
        out: list[Value] = []
        for place in places:
            if place and place != self.c.at:
                raise FormatError("an element is not where the array says")
            if len(out) < n:
                out.append(self.value())
        return out

    def entries(self) -> list[tuple[str, Value]]:
        out = []
        while self.c.take(1) != b"\xff":
            self.c.at -= 1
            kind, key = self.value()
            if kind != "str":
                raise FormatError("a key that is no string")
            out.append((key, self.value()))
        return out


def _from_hex(digits: str) -> bytes:
    try:
        return bytes.fromhex(digits)
    except ValueError as error:
        raise FormatError(str(error)) from error


def decode(data: bytes) -> Value:
    """The document; bytes after its end mark are ignored."""
    r = _Reader(data)
    if r.c.take(4) != HEADER:
        raise FormatError("not a tagged tree")
    low, high = r.c.u16(), r.c.u16()
    if low != 1 or high > 1:
        raise FormatError(f"version {high << 16 | low}")
    first = data[r.c.at] if r.c.left else -1
    if high and first != 0xB8:
        raise FormatError("a compact tree has a compact object at its root")
    if first in (0x85, 0xB8):
        r.c.at += 1
    try:
        root = "object", r.entries()
    except RecursionError as error:
        raise FormatError("too deep") from error
    if r.c.data[r.c.at : r.c.at + 4] != FOOTER:
        raise FormatError("no end mark")
    return root


# writing


def _is_latin(text: str) -> bool:
    return all(ord(x) <= 0xFF for x in text)


class _Plain:
    """The standard form: strings are written once, Latin-1 and others numbered apart."""

    def __init__(self) -> None:
        self.w = Writer()
        self.latin: dict[str, int] = {}
        self.utf8: dict[str, int] = {}

    def utf8_text(self, text: str) -> None:
        raw = text.encode()
        self.w.varint(len(text))
        self.w.varint(len(raw))
        self.w.raw(raw)

    def text(self, text: str) -> None:
        w = self.w
        if text == "*":
            return w.put("B", 0x02)
        if text == "RTID(0)":
            return w.put("B", 0x84)
        latin = _is_latin(text)
        held = self.latin if latin else self.utf8
        if text in held:
            w.put("B", 0x91 if latin else 0x93)
            return w.varint(held[text])
        held[text] = len(held)
        w.put("B", 0x90 if latin else 0x92)
        if latin:
            w.varint(len(text))
            w.raw(text.encode("latin-1"))
        else:
            self.utf8_text(text)

    def number(self, tag: str, n: int) -> None:
        """The shortest of raw, zigzag and fixed width, as the format's writers choose."""
        w, bits = self.w, int(tag[1:])
        if n == 0:
            return w.put("B", _ZERO_OF[tag])
        if bits < 32:
            return w.put("B" + _FORM_OF[tag], _TAG_OF[tag], n)
        raw = n & ((1 << bits) - 1)
        fixed = 4 if bits == 32 else 8
        if tag[0] == "u":
            if varint_size(raw) >= fixed:
                return w.put("B" + _FORM_OF[tag], _TAG_OF[tag], n)
            w.put("B", 0x28 if bits == 32 else 0x48)
            return w.varint(raw)
        zig = zigzag_of(n, bits)
        if varint_size(raw) >= fixed and varint_size(zig) >= fixed:
            return w.put("B" + _FORM_OF[tag], _TAG_OF[tag], n)
        if varint_size(zig) < varint_size(raw):
            w.put("B", 0x25 if bits == 32 else 0x45)
            return w.varint(zig)
        w.put("B", 0x24 if bits == 32 else 0x44)
        w.varint(raw)

    def rtid(self, r: dict) -> None:
        w = self.w
        if r["kind"] == "raw":
            w.put("B", 3)
            self.utf8_text(r["name"])
            return self.utf8_text(r["parent"])
        if r["name"]:
            w.put("B", 2)
            self.utf8_text(r["name"])
        else:
            w.put("B", 1)
        w.varint(r["group"])
        w.varint(r["id"])
        w.put("I", r["obj"])

    def value(self, value: Value) -> None:
        w, (tag, x) = self.w, value
        if tag == "null" or tag == "rtid" and x["kind"] == "null":
            w.put("B", 0x84)
        elif tag == "bool":
            w.put("B", int(x))
        elif tag in ("f32", "f64"):
            if x == 0:
                w.put("B", _ZERO_OF[tag])
            else:
                w.put("B" + _FORM_OF[tag], _TAG_OF[tag], x)
        elif tag[0] in "iu":
            self.number(tag, x)
        elif tag[0] == "v":
            bits, signed = int(tag[2:]), tag[1] == "i"
            w.put("B", (0x25 if signed else 0x28) + (0x20 if bits == 64 else 0))
            w.varint(zigzag_of(x, bits) if signed else x)
        elif tag == "str":
            self.text(x)
        elif tag == "bin":
            w.put("BB", 0x87, 0)
            digits = x.hex().upper().encode()
            w.varint(len(digits))
            w.raw(digits)
            w.varint(len(x))
            w.raw(x)
        elif tag == "rtid":
            w.put("B", 0x83)
            self.rtid(x)
        elif tag == "array":
            w.put("BB", 0x86, 0xFD)
            w.varint(len(x))
            for y in x:
                self.value(y)
            w.put("B", 0xFE)
        elif tag == "object":
            w.put("B", 0x85)
            self.entries(x)
        else:
            raise FormatError(f"no such tag: {tag}")

    def entries(self, entries: list) -> None:
        for key, y in entries:
            self.text(key)
            self.value(y)
        self.w.put("B", 0xFF)


def encode(root: Value) -> bytes:
    p = _Plain()
    p.w.raw(HEADER)
    p.w.put("I", STANDARD)
    if root[0] != "object":
        raise FormatError("the root is an object")
    p.entries(root[1])
    p.w.raw(FOOTER)
    return p.w.done()


class _Compact(_Plain):
    """The compact form: strings by place, and the places of elements and values in front of them."""

    def __init__(self) -> None:
        super().__init__()
        self.places: dict[tuple[bool, str], int] = {}

    def compact_text(self, text: str, paired: bool) -> int | None:
        """Returns where the value's place is to be written, for a key."""
        w, latin = self.w, _is_latin(text)
        base = (0xB0 if latin else 0xB2) + (4 if paired else 0)
        if (latin, text) in self.places:
            w.put("BI", base + 1, self.places[latin, text])
        else:
            raw = text.encode("latin-1") + b"\0" if latin else text.encode("utf-32-le") + bytes(4)
            w.put("BI", base, len(raw))
            self.places[latin, text] = len(w)
            w.raw(raw)
        if not paired:
            return None
        w.put("I", 0)
        return len(w) - 4

    def value(self, value: Value) -> None:
        w, (tag, x) = self.w, value
        if tag == "null" or tag == "rtid" and x["kind"] == "null":
            w.put("BB", 0xBA, 0)
        elif tag == "bool":
            w.put("BB", 0xBC, int(x))
        elif tag in _FORM_OF or tag[0] == "v":
            tag = tag.removeprefix("v")
            w.put("B" + _FORM_OF[tag], _TAG_OF[tag], x)
        elif tag == "str":
            self.compact_text(x, False)
        elif tag == "bin":
            w.put("B", 0xBB)
            self.compact_text(x.hex().upper(), False)
            w.put("I", len(x))
            w.raw(x)
        elif tag == "rtid":
            w.put("B", 0xBA)
            self.rtid(x)
        elif tag == "array":
            w.put("BBI", 0xB9, 0xFD, len(x))
            table = len(w)
            w.raw(bytes(4 * (len(x) + 1)))
            for i, y in enumerate(x):
                w.patch(table + 4 * i, "I", len(w))
                self.value(y)
            w.patch(table + 4 * len(x), "I", len(w))
        elif tag == "object":
            w.put("B", 0xB8)
            for key, y in x:
                place = self.compact_text(key, True)
                self.value(y)
                w.patch(place, "I", len(w))
            w.put("B", 0xFF)
        else:
            raise FormatError(f"no such tag: {tag}")


def encode_compact(root: Value) -> bytes:
    c = _Compact()
    c.w.raw(HEADER)
    c.w.put("I", COMPACT)
    c.value(root)
    c.w.raw(FOOTER)
    return c.w.done()


# JSON and tables


def narrowest(n: int) -> Value:
    """The smallest type that holds a JSON number: unsigned types for those not below zero."""
    if n >= 0:
        for bits in (8, 16, 32, 64):
            if n < 1 << bits:
                return f"u{bits}", n
    else:
        for bits in (8, 16, 32, 64):
            if n >= -(1 << (bits - 1)):
                return f"i{bits}", n
    raise FormatError(f"{n} fits no integer type")


class _Entries(list):
    """A JSON object as read: pairs, in order."""


def from_json(text: str) -> Value:
    def typed(x) -> Value:
        if x is None:
            return NULL
        if isinstance(x, bool):
            return "bool", x
        if isinstance(x, int):
            return narrowest(x)
        if isinstance(x, float):
            return "f64", x
        if isinstance(x, str):
            if x.startswith("RTID("):
                try:
                    found = parse_rtid(x)
                except FormatError:
                    return "str", x
                return NULL if found["kind"] == "null" else ("rtid", found)
            if (m := re.fullmatch(r'\$BINARY\("([0-9A-Fa-f]*)",\s*(\d+)\)', x)) and len(m[1]) == 2 * int(m[2]):
                return "bin", _from_hex(m[1])
            return "str", x
        if isinstance(x, _Entries):
            return "object", [(k, typed(v)) for k, v in x]
        return "array", [typed(v) for v in x]

    return typed(json.loads(text, object_pairs_hook=_Entries))


def _scalar(value: Value):
    tag, x = value
    if tag == "bin":
        return f'$BINARY("{x.hex().upper()}", {len(x)})'
    if tag == "rtid":
        return format_rtid(x)
    if tag == "f32":
        return float(repr(struct.unpack("<f", struct.pack("<f", x))[0])) if x != x else float(f"{x:.9g}")
    return x


def to_json(value: Value, indent: int = 2) -> str:
    """Pretty JSON; keys that repeat stay."""

    def write(v: Value, depth: int) -> str:
        tag, x = v
        pad, end = " " * indent * (depth + 1), " " * indent * depth
        if tag == "array":
            return "[\n" + ",\n".join(pad + write(y, depth + 1) for y in x) + f"\n{end}]" if x else "[]"
        if tag == "object":
            return "{\n" + ",\n".join(f"{pad}{json.dumps(k, ensure_ascii=False)}: {write(y, depth + 1)}" for k, y in x) + f"\n{end}}}" if x else "{}"
        return json.dumps(_scalar(v), ensure_ascii=False)

    return write(value, 0)


def nodes(root: Value) -> list[tuple]:
    """(path, ordinal, tag, key, value as text) for every node, parents first: the tree as rows."""
    out = []

    def walk(value: Value, path: str, key: str | None) -> None:
        tag, x = value
        held = None if tag in ("array", "object", "null") else str(_scalar(value)).lower() if tag == "bool" else str(_scalar(value))
        out.append((path, len(out), tag, key, held))
        if tag == "array":
            for i, y in enumerate(x):
                walk(y, f"{path}[{i}]", None)
        elif tag == "object":
            for k, y in x:
                walk(y, f"{path}.{k}", k)

    walk(root, "$", None)
    return out
