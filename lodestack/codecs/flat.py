"""Flat archives: a directory of paths, sizes and times, then the payloads one after another; and ZIP archives behind the same rows.

A file does not say which of its layouts it has. Every layout that its first
bytes allow is tried on the directory and the payloads' places, without reading
payloads; exactly one must fit.
"""

from __future__ import annotations

import io
import json
import itertools
import zipfile
import zlib
from dataclasses import dataclass, field

from .binary import Cursor, FormatError, Writer
from .wrappers import inflate

#: Fixed values of the format.
MAGIC, VERSION, XOR, END = 0xBAC04AC0, 0, 0xF7, 0x80
PROFILES = ("xor", "plain", "aligned")
_XORED = bytes(i ^ XOR for i in range(256))


class NoLayout(FormatError):
    """No layout fits; ``attempts`` has the reasons."""

    def __init__(self, attempts: list[tuple[tuple, str]]) -> None:
        super().__init__("no layout fits: " + "; ".join(f"{'/'.join(k)}: {why}" for k, why in attempts))
        self.attempts = attempts


class Ambiguous(FormatError):
    """More than one layout fits; ``layouts`` has them."""

    def __init__(self, layouts: list[tuple]) -> None:
        super().__init__("more than one layout fits: " + ", ".join("/".join(x) for x in layouts))
        self.layouts = layouts


@dataclass(frozen=True)
class Limits:
    """What an archive may ask for, checked before anything is allocated."""

    entries: int = 1_000_000
    path_bytes: int = 64 << 20
    directory_bytes: int = 256 << 20
    entry_stored: int = 2 << 30
    entry_size: int = 4 << 30
    total_size: int = 16 << 30


@dataclass
class Entry:
    path: bytes
    kind: str = "file"
    time: dict = field(default_factory=lambda: {"kind": "none", "value": None, "date": None, "clock": None})
    stored_size: int = 0
    original_size: int = 0
    offset: int = 0


@dataclass
class Index:
    profile: str
    compression: str
    layout: str
    separator: str
    entries: list[Entry]


def _check(what: str, n: int, limit: int) -> None:
    if n > limit:
        raise FormatError(f"{what}: {n} wanted, at most {limit} allowed")


def _layouts(data: bytes, legacy: bool, exact: tuple[str, str] | None) -> list[tuple[str, str, str]]:
    """(profile, compression, directory layout) that the first four bytes allow."""
    first = data[:4]
    plain = MAGIC.to_bytes(4, "little")
    allowed = {plain: ("plain", "aligned"), plain.translate(_XORED): ("xor",)}.get(first)
    if not allowed:
        raise FormatError(f"no archive begins with {first.hex()}")
    if exact and exact[0] not in allowed:
        raise FormatError(f"no {exact[0]} archive begins with {first.hex()}")
    out = []
    for profile in (exact[0],) if exact else allowed:
        for compression in (exact[1],) if exact else ("none", "zlib"):
            kinds = ("plain",) if compression == "none" else ("canonical", "legacy") if legacy else ("canonical",)
            out += [(profile, compression, kind) for kind in kinds]
    return out


def _parse(data: bytes, clear: bytes, profile: str, compression: str, layout: str, strict: bool, limits: Limits) -> list[Entry]:
    """The directory and the payloads' places; the payloads must end with the file."""
    c = Cursor(clear)
    if c.u32() != MAGIC:
        raise FormatError("no magic")
    if (version := c.u32()) != VERSION:
        raise FormatError(f"version {version}")
    entries: list[Entry] = []
    paths = total = 0
    while (mark := c.u8()) != END:
        if mark:
            raise FormatError(f"marker {mark:#x} at {c.at - 1}")
        _check("entries", len(entries) + 1, limits.entries)
        length = c.u8()
        paths += length
        _check("path bytes", paths, limits.path_bytes)
        path, size = c.take(length), c.u32()
        stored = original = size
        if layout == "canonical":
            original = c.u32()
        elif layout == "legacy":
            stored = c.u32()
        time = c.u64()
        total += original
        for what, n, limit in (("stored bytes", stored, limits.entry_stored), ("bytes", original, limits.entry_size), ("bytes together", total, limits.total_size)):
            _check(what, n, limit)
        entries.append(Entry(path, time={"kind": "raw", "value": time, "date": None, "clock": None}, stored_size=stored, original_size=original))
    _check("directory bytes", c.at, limits.directory_bytes)
    for e in entries:
        if profile == "aligned":
            fill = c.u16()
            if strict and not 1 <= fill <= 8:
                raise FormatError(f"{fill} bytes of padding")
            if c.take(fill).strip(b"\0") and strict:
                raise FormatError("padding that is not zero")
            if c.at % 8:
                raise FormatError(f"a payload at {c.at}, no multiple of 8")
        e.offset = c.at
        payload = c.take(e.stored_size)
        if compression == "zlib" and (len(payload) < 2 or payload[0] & 15 != 8 or payload[0] >> 4 > 7 or (payload[0] << 8 | payload[1]) % 31 or payload[1] & 0x20):
            raise FormatError(f"no zlib stream at {e.offset}")
    if c.left:
        raise FormatError(f"{c.left} bytes after the payloads")
    return entries


def separator_of(paths) -> str:
    forward = backward = False
    for p in paths:
        forward |= b"/" in p
        backward |= b"\\" in p
    return "preserve" if forward == backward else "/" if forward else "\\"


def read_index(data: bytes, exact: tuple[str, str] | None = None, legacy: bool = True, strict: bool = True, limits: Limits = Limits()) -> Index:
    """The directory of a flat or ZIP archive. ``exact`` names (profile, compression) instead of trying all."""
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return _zip_index(data, limits)
    clear, fits, failed = {}, [], []
    for layout in _layouts(data, legacy, exact):
        key = layout[0] == "xor"
        if key not in clear:
            clear[key] = data.translate(_XORED) if key else data
        try:
            fits.append((layout, _parse(data, clear[key], *layout, strict, limits)))
        except FormatError as error:
            failed.append((layout, str(error)))
    if not fits:
        raise NoLayout(failed)
    if not exact and not any(entries for _, entries in fits):
        # an empty archive fits all: it counts as plain and not compressed
        fits = [x for x in fits if x[0][1] == "none"]
        if len(fits) > 1:
            fits = [x for x in fits if x[0][0] == "plain"]
    canonical = {x[0][:2] for x in fits if x[0][2] == "canonical"}
    fits = [x for x in fits if x[0][2] != "legacy" or x[0][:2] not in canonical]
    if len(fits) != 1:
        raise Ambiguous([x[0] for x in fits])
    (profile, compression, layout), entries = fits[0]
    return Index(profile, compression, layout, separator_of(e.path for e in entries), entries)


def _zip_index(data: bytes, limits: Limits) -> Index:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
    except (zipfile.BadZipFile, NotImplementedError, ValueError) as error:
        raise FormatError(str(error)) from error
    _check("entries", len(infos), limits.entries)
    _check("bytes together", sum(i.file_size for i in infos), limits.total_size)
    entries = []
    for i in infos:
        y, mo, d, h, mi, s = i.date_time
        raw = i.orig_filename.encode("utf-8" if i.flag_bits & 0x800 else "cp437", "replace")
        entries.append(Entry(raw, "directory" if i.is_dir() else "file", {"kind": "dos", "value": None, "date": max(0, y - 1980) << 9 | mo << 5 | d, "clock": h << 11 | mi << 5 | s // 2}, i.compress_size, i.file_size, i.header_offset))
    methods = {i.compress_type for i in infos if i.file_size}
    return Index("zip", "zlib" if zipfile.ZIP_DEFLATED in methods else "none", "zip", separator_of(e.path for e in entries), entries)


def detached(index: Index) -> str:
    """An index as text, to be kept without its archive."""
    return json.dumps({k: getattr(index, k) for k in ("profile", "compression", "layout", "separator")} | {"entries": [[e.path.decode("latin-1"), e.kind, e.time, e.stored_size, e.original_size, e.offset] for e in index.entries]})


def attached(text: str, data: bytes) -> Index:
    """A kept index for these bytes; fails where an entry does not lie in them."""
    held = json.loads(text)
    entries = [Entry(path.encode("latin-1"), *rest) for path, *rest in held.pop("entries")]
    if held["profile"] != "zip" and any(e.offset + e.stored_size > len(data) for e in entries):
        raise FormatError("an entry lies behind the archive's end")
    return Index(**held, entries=entries)


def sub_range(data: bytes, start: int, length: int | None = None) -> bytes:
    """The archive that lies at ``start`` of a larger file."""
    end = len(data) if length is None else start + length
    if not 0 <= start <= end <= len(data):
        raise FormatError(f"bytes {start} to {end} of {len(data)}")
    return data[start:end]


def read_entry(data: bytes, index: Index, at: int) -> bytes:
    """One payload; the size must be what the directory says."""
    e = index.entries[at]
    if index.profile == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            try:
                return z.read(z.infolist()[at])
            except (zipfile.BadZipFile, NotImplementedError, zlib.error) as error:
                raise FormatError(str(error)) from error
    raw = data[e.offset : e.offset + e.stored_size]
    raw = raw.translate(_XORED) if index.profile == "xor" else raw
    return inflate(raw, e.original_size) if index.compression == "zlib" else raw


def _with_separator(path: bytes, separator: str) -> bytes:
    if separator == "preserve":
        return path
    return path.replace(b"\\", b"/") if separator == "/" else path.replace(b"/", b"\\")


def lost_in_flat(entries: list[Entry], comment: bytes = b"") -> list[tuple[int | None, str]]:
    """What a flat archive can't hold: (ordinal, change) for each."""
    out: list[tuple[int | None, str]] = [(None, "comment dropped")] if comment else []
    for i, e in enumerate(entries):
        if e.kind != "file":
            out.append((i, "entry dropped"))
        elif e.time["kind"] == "dos":
            out.append((i, "time dropped"))
    return out


def write(entries: list[tuple[Entry, bytes]], profile: str = "xor", compression: str = "none", separator: str = "preserve", level: int = 6) -> bytes:
    """A flat archive, or with profile ``zip`` a ZIP one."""
    if profile == "zip":
        return _write_zip(entries, compression, separator)
    w, places, stored = Writer(), [], []
    w.put("II", MAGIC, VERSION)
    for e, payload in entries:
        path = _with_separator(e.path, separator)
        if not path or len(path) > 255:
            raise FormatError("paths have 1 to 255 bytes")
        if e.kind != "file" or e.time["kind"] == "dos":
            raise FormatError("a flat archive holds files and raw times alone")
        w.put("BB", 0, len(path))
        w.raw(path)
        places.append(len(w))
        w.put("I", len(payload))
        if compression == "zlib":
            w.put("I", len(payload))
        w.put("Q", e.time["value"] or 0)
    w.put("B", END)
    for _, payload in entries:
        if profile == "aligned":
            fill = next(n for n in itertools.count(1) if (len(w) + 2 + n) % 8 == 0)
            w.put("H", fill)
            w.raw(bytes(fill))
        raw = zlib.compress(payload, level) if compression == "zlib" else payload
        stored.append(len(raw))
        w.raw(raw)
    for place, size in zip(places, stored):
        w.patch(place, "I", size)
    return w.done().translate(_XORED) if profile == "xor" else w.done()


def _write_zip(entries: list[tuple[Entry, bytes]], compression: str, separator: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if compression == "zlib" else zipfile.ZIP_STORED) as z:
        for e, payload in entries:
            date, clock = (e.time["date"], e.time["clock"]) if e.time["kind"] == "dos" else (0x21, 0)
            info = zipfile.ZipInfo(_with_separator(e.path, separator).decode("utf-8", "replace"), ((date >> 9) + 1980, max(1, date >> 5 & 15), max(1, date & 31), clock >> 11, clock >> 5 & 63, clock % 32 * 2))
            info.compress_type = z.compression
            z.writestr(info, payload)
    return out.getvalue()
