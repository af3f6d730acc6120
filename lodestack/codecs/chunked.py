"""Chunked archives over one or more volumes: strings, files as lists of chunks, chunks with a codec each."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator

from .binary import Cursor, FormatError, Writer

#: The mark, and flags of chunks. Of several codecs the first in RANK rules.
MAGIC = 0x5A525444
COMMON, DZ, ZLIB, BZIP, MP3, JPEG, ZERO, COPY, LZMA, RANDOM = 1, 4, 8, 16, 32, 64, 128, 256, 512, 1024
RANK = (("zero", ZERO), ("bzip", BZIP), ("copy", COPY), ("zlib", ZLIB), ("lzma", LZMA), ("dz", DZ))
_KNOWN = COMMON | DZ | ZLIB | BZIP | MP3 | JPEG | ZERO | COPY | LZMA | RANDOM
ROOT = 0
LIMIT = 1 << 30
#: The format's dictionary of 64 KB; a larger one costs each chunk its memory, when written and when read.
_LZMA = [{"id": lzma.FILTER_LZMA1, "preset": lzma.PRESET_DEFAULT, "dict_size": 1 << 16}]


def codec_of(flags: int) -> str | None:
    return next((name for name, bit in RANK if flags & bit), None)


def is_boundary(chunk: dict) -> bool:
    """Whether the chunk takes room in its volume."""
    return not chunk["flags"] & ZERO and bool(chunk["compressed_length"] or chunk["flags"] & BZIP)


def has_placeholder(chunk: dict) -> bool:
    """Whether the stored length is only the unpacked one again."""
    return bool(chunk["flags"] & (LZMA | ZLIB | BZIP | DZ)) and chunk["compressed_length"] == chunk["decompressed_length"]


def resolve_layout(chunks: list[dict], sizes: dict[int, int]) -> list[int]:
    """The physical length of each chunk: up to the next one in its volume, the last to the volume's end."""
    out = [c["compressed_length"] if is_boundary(c) else 0 for c in chunks]
    for volume in {c["file"] for c in chunks}:
        own = sorted((i for i, c in enumerate(chunks) if c["file"] == volume and is_boundary(c)), key=lambda i: chunks[i]["offset"])
        for i, after in zip(own, [chunks[j]["offset"] for j in own[1:]] + [sizes.get(volume)]):
            if after is not None:
                room = max(0, after - chunks[i]["offset"])
                out[i] = room if has_placeholder(chunks[i]) else min(room, chunks[i]["compressed_length"])
    return out


def _text(c: Cursor) -> bytes:
    return c.c_string()


def read_index(data: bytes) -> dict:
    """files (path, directory, chunks), chunks (offset, lengths, flags, file) and volume names."""
    c = Cursor(data)
    if c.u32() != MAGIC:
        raise FormatError("not a chunked archive")
    n_files, n_folders, version = c.u16(), c.u16(), c.u8()
    if version or not n_files or not n_folders:
        raise FormatError(f"version {version}, {n_files} files, {n_folders} folders")
    names = [_text(c) for _ in range(n_files + n_folders - 1)]
    files, folders = names[:n_files], [b"", *names[n_files:]]
    maps = []
    for _ in range(n_files):
        folder, ids = c.u16(), []
        while (k := c.u16()) != 0xFFFF:
            ids.append(k)
        if folder >= len(folders):
            raise FormatError("a file in no folder")
        maps.append((folder, ids))
    n_volumes, n_chunks = c.u16(), c.u16()
    if not n_volumes:
        raise FormatError("no volumes")
    chunks = [dict(zip(("offset", "compressed_length", "decompressed_length", "flags", "file"), c.unpack("3I2H"))) for _ in range(n_chunks)]
    volumes = [_text(c) for _ in range(n_volumes - 1)]
    settings = list(c.take(10)) if any(x["flags"] & DZ for x in chunks) else None
    out = []
    for name, (folder, ids) in zip(files, maps):
        if any(k >= n_chunks for k in ids):
            raise FormatError("a file with a chunk that there is not")
        path = (folders[folder] + b"/" if folders[folder] else b"") + name
        out.append({"path": path.decode("utf-8", "replace").replace("\\", "/"), "chunks": ids, "size": sum(chunks[k]["decompressed_length"] for k in ids)})
    return {"version": version, "files": out, "chunks": chunks, "volumes": [v.decode("utf-8", "replace") for v in volumes], "settings": settings}


def _decoded(raw: bytes, chunk: dict) -> bytes:
    size, name = chunk["decompressed_length"], codec_of(chunk["flags"])
    if chunk["flags"] & ~_KNOWN or name is None:
        raise FormatError(f"chunk flags {chunk['flags']:#x}")
    if size > LIMIT:
        raise FormatError(f"a chunk of {size} bytes")
    try:
        if name == "zero":
            out = bytes(size)
        elif name == "copy":
            out = raw[:size]
        elif name == "bzip":
            out = bz2.BZ2Decompressor().decompress(raw, size) if raw else b""
        elif name == "zlib":
            out = zlib.decompressobj().decompress(raw, size) if size else b""
        elif name == "lzma":
            out = lzma.LZMADecompressor(lzma.FORMAT_ALONE).decompress(raw, size) if size else b""
        else:
            raise FormatError("the dz codec is not decoded")
    except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError) as error:
        raise FormatError(f"{name}: {error}") from error
    if len(out) != size:
        raise FormatError(f"{len(out)} bytes unpacked, {size} declared")
    return out


def _file(volumes: list[bytes], index: dict, at: int, spans: list[int]) -> bytes:
    out = []
    for k in index["files"][at]["chunks"]:
        chunk = index["chunks"][k]
        if chunk["file"] >= len(volumes):
            raise FormatError(f"volume {chunk['file']} is not there")
        size = chunk["decompressed_length"] if codec_of(chunk["flags"]) == "copy" else spans[k]
        raw = Cursor(volumes[chunk["file"]], chunk["offset"]).take(size) if size and codec_of(chunk["flags"]) != "zero" else b""
        out.append(_decoded(raw, chunk))
    return b"".join(out)


def _spans(volumes: list[bytes], index: dict) -> list[int]:
    return resolve_layout(index["chunks"], {k: len(v) for k, v in enumerate(volumes)})


def read_file(volumes: list[bytes], index: dict, at: int) -> bytes:
    """A file's chunks one after the other."""
    return _file(volumes, index, at, _spans(volumes, index))


def read_files(volumes: list[bytes], index: dict) -> Iterator[bytes]:
    """Every file in order; the chunks' places are worked out once for all."""
    spans = _spans(volumes, index)
    return (_file(volumes, index, at, spans) for at in range(len(index["files"])))


def _encoded(data: bytes, name: str) -> bytes:
    if name == "zero":
        if data.strip(b"\0"):
            raise FormatError("the zero codec holds zero bytes alone")
        return b""
    return {"copy": bytes, "bzip": bz2.compress, "zlib": lambda d: zlib.compress(d, 9), "lzma": lambda d: lzma.compress(d, lzma.FORMAT_ALONE, filters=_LZMA)}[name](data)


def write(files: list[tuple[str, bytes, str]]) -> bytes:
    """One volume of (path, data, codec)."""
    return write_volumes([(*f, 0) for f in files])[0]


def write_volumes(files: list[tuple[str, bytes, str, int]], names: list[str] | None = None) -> list[bytes]:
    """Volumes of (path, data, codec, volume); the first holds the index, ``names`` are those of the others.

    Folders are numbered as they first appear, without regard to case; chunks
    are written by codec rank, then in order.
    """
    names = names or []
    folders: dict[str, tuple[int, str]] = {"": (ROOT, "")}
    rows, titles, seen = [], [], set()
    for path, data, codec, volume in files:
        if codec not in dict(RANK) or codec == "dz":
            raise FormatError(f"{codec} is not encoded")
        if not 0 <= volume <= len(names):
            raise FormatError(f"no volume {volume}")
        if path.lower() in seen:
            raise FormatError(f"two files have the path {path}")
        seen.add(path.lower())
        folder, _, name = path.replace("\\", "/").rpartition("/")
        folders.setdefault(folder.lower(), (len(folders), folder))
        rows.append((folders[folder.lower()][0], data, codec, volume))
        titles.append(name)
    order = sorted(range(len(rows)), key=lambda k: [n for n, _ in RANK].index(rows[k][2]))
    parts = {k: _encoded(rows[k][1], rows[k][2]) for k in order}
    w = Writer()
    w.put("I2HB", MAGIC, len(rows), len(folders), 0)
    for name in (*titles, *(f for n, f in sorted(folders.values()) if n)):
        w.raw(name.replace("/", "\\").encode() + b"\0")
    for k, row in enumerate(rows):
        w.put("3H", row[0], k, 0xFFFF)
    w.put("2H", 1 + len(names), len(rows))
    tail = b"".join(n.encode() + b"\0" for n in names)
    ends = [len(w) + 16 * len(rows) + len(tail)] + [0] * len(names)
    places = {}
    for k in order:
        places[k] = ends[rows[k][3]]
        ends[rows[k][3]] += len(parts[k])
    for k, (_, data, codec, volume) in enumerate(rows):
        # the writers of these codecs store the unpacked length
        stored = len(data) if codec in ("zlib", "bzip", "lzma") else len(parts[k])
        w.put("3I2H", places[k], stored, len(data), dict(RANK)[codec], volume)
    w.raw(tail)
    return [(w.done() if v == 0 else b"") + b"".join(parts[k] for k in order if rows[k][3] == v) for v in range(1 + len(names))]
