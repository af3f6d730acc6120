"""Keyframe tracks: sparse transforms by frame, in three layouts. A value of -10000 stands for "unchanged" and comes out as None."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from .binary import Cursor, FormatError, Writer
from .wrappers import ZLIB_MAGIC, inflate

NONE = -10000.0
FIELDS = ("x", "y", "kx", "ky", "sx", "sy", "f", "a")
TEXTS = ("i", "font", "text")
#: What a file may ask for.
LIMIT_BYTES, LIMIT_TRACKS, LIMIT_FRAMES, LIMIT_TEXT = 512 << 20, 1 << 16, 1 << 20, 1 << 20


@dataclass(frozen=True)
class Layout:
    """Fixed values of a layout: its first word, and how many bytes mean nothing where."""

    word: int
    wide: bool
    prefix: int
    reserved: int
    mark: int
    track_prefix: int
    track_suffix: int
    track_mark: int
    tail: int
    image_is_text: bool


LAYOUTS = {
    "pc": Layout(-1282165568, False, 8, 4, 0x0C, 8, 0, 0x2C, 12, True),
    "phone32": Layout(-14326347, False, 8, 4, 0x10, 12, 0, 0x2C, 12, False),
    "phone64": Layout(-1069095568, True, 12, 8, 0x20, 24, 4, 0x38, 24, False),
}


def _payload(data: bytes, wide: bool) -> bytes:
    if len(data) < 4 or struct.unpack_from("<I", data)[0] != ZLIB_MAGIC:
        return data
    head = 16 if wide else 8
    if len(data) < head:
        raise FormatError("the container is cut off")
    if wide:
        a, size, b = struct.unpack_from("<3I", data, 4)
        if a or b:
            raise FormatError("not a wide container")
    else:
        size = struct.unpack_from("<I", data, 4)[0]
    if size > LIMIT_BYTES:
        raise FormatError(f"{size} bytes declared")
    return inflate(data[head:], size)


def _count(c: Cursor, limit: int) -> int:
    n = c.i32()
    if not 0 <= n <= limit:
        raise FormatError(f"a count of {n}")
    return n


def _text(c: Cursor) -> str | None:
    try:
        return c.take(_count(c, LIMIT_TEXT)).rstrip(b"\0").decode() or None
    except UnicodeDecodeError as error:
        raise FormatError(str(error)) from error


def decode_as(data: bytes, version: str) -> dict:
    """fps and tracks (name, frames); a frame has x, y, kx, ky, sx, sy, f, a, i, font, text."""
    k = LAYOUTS[version]
    c = Cursor(_payload(data, k.wide))
    c.take(k.prefix)
    n, fps = _count(c, LIMIT_TRACKS), c.f32()
    c.take(k.reserved)
    if (mark := c.u32()) != k.mark:
        raise FormatError(f"mark {mark:#x} where {k.mark:#x} belongs")
    lengths = []
    for _ in range(n):
        c.take(k.track_prefix)
        lengths.append(_count(c, LIMIT_FRAMES))
        c.take(k.track_suffix)
    tracks = []
    for length in lengths:
        name = _text(c) or ""
        if c.u32() != k.track_mark:
            raise FormatError(f"no track where {name!r} belongs")
        frames = []
        for _ in range(length):
            values = c.unpack("8f")
            frames.append({f: None if v == NONE else v for f, v in zip(FIELDS, values)})
            c.take(k.tail)
        for frame in frames:
            if k.image_is_text:
                frame["i"] = _text(c)
            else:
                image = c.i32()
                frame["i"] = None if image == -1 else str(image)
            frame["font"], frame["text"] = _text(c), _text(c)
        tracks.append({"name": name, "frames": frames})
    return {"fps": fps, "tracks": tracks}


def decode(data: bytes) -> tuple[dict, str]:
    """The first layout that fits, in their order, and its name."""
    why = []
    for version in LAYOUTS:
        try:
            return decode_as(data, version), version
        except FormatError as error:
            why.append(f"{version}: {error}")
    raise FormatError("; ".join(why))


def encode(animation: dict, version: str = "pc") -> bytes:
    k, w = LAYOUTS[version], Writer()

    def text(x: str | None) -> None:
        raw = (x or "").encode()
        w.put("i", len(raw))
        w.raw(raw)

    w.put("i", k.word)
    w.raw(bytes(k.prefix - 4))
    w.put("if", len(animation["tracks"]), animation["fps"])
    w.raw(bytes(k.reserved))
    w.put("I", k.mark)
    for track in animation["tracks"]:
        w.raw(bytes(k.track_prefix))
        w.put("i", len(track["frames"]))
        w.raw(bytes(k.track_suffix))
    for track in animation["tracks"]:
        text(track["name"])
        w.put("I", k.track_mark)
        for frame in track["frames"]:
            w.put("8f", *(NONE if frame.get(f) is None else frame[f] for f in FIELDS))
            w.raw(bytes(k.tail))
        for frame in track["frames"]:
            image = frame.get("i")
            if k.image_is_text:
                text(image)
            else:
                try:
                    w.put("i", int(image))
                except (TypeError, ValueError):
                    w.put("i", -1)
            text(frame.get("font"))
            text(frame.get("text"))
    raw = w.done()
    head = struct.pack("<4I", ZLIB_MAGIC, 0, len(raw), 0) if k.wide else struct.pack("<2I", ZLIB_MAGIC, len(raw))
    return head + zlib.compress(raw, 6)


def rows(animation: dict) -> list[dict]:
    """(track, name, frame, fields): the keyframe table."""
    return [{"track": t, "name": track["name"], "frame": n} | frame for t, track in enumerate(animation["tracks"]) for n, frame in enumerate(track["frames"])]
