"""Sprite animations, versions 1 to 6: images, sprites, and frames that remove, append and change layers. Numbers are fixed-point on the wire."""

from __future__ import annotations

import math

from .binary import Cursor, FormatError, Writer

#: The mark, the scales, the flags of frames and changes, the index escapes.
MAGIC = 0xBAF01954
TWIP, ANGLE, MATRIX, IMAGE_MATRIX, COLOUR = 20.0, 1000.0, 65536.0, 1310720.0, 255.0
REMOVES, ADDS, MOVES, LABEL, STOP, COMMANDS = 1, 2, 4, 8, 16, 32
SPRITE, ADDITIVE, PRELOAD, NAMED, SCALED, LAYER = 32768, 16384, 8192, 4096, 2048, 2047
RECT, ROTATE, TINT, FULL, LONG, FRAME_NUMBER, MOVED = 32768, 16384, 8192, 4096, 2048, 1024, 1023
#: On the wire a matrix a b c d comes as a c b d.
_WIRE = (0, 2, 1, 3)


def _text(c: Cursor) -> str:
    return c.take(c.u16()).decode("utf-8", "replace")


def _many(c: Cursor) -> int:
    n = c.u8()
    return c.u16() if n == 255 else n


def _index(c: Cursor, word: int, mask: int) -> int:
    n = word & mask
    return c.i32() if n == mask else n


def _matrix(c: Cursor, scale: float) -> list[float]:
    out = [0.0] * 4
    for place in _WIRE:
        out[place] = c.i32() / scale
    return out


def _read_image(c: Cursor, version: int) -> dict:
    name = _text(c)
    size = list(c.unpack("2h")) if version >= 4 else None
    turn = [c.i16() / ANGLE] if version == 1 else _matrix(c, IMAGE_MATRIX)
    return {"name": name, "size": size, "transform": turn + [v / TWIP for v in c.unpack("2h")]}


def _read_append(c: Cursor, version: int) -> dict:
    word = c.u16()
    index, resource = _index(c, word, LAYER), c.u8()
    if version >= 6 and resource == 255:
        resource = c.u16()
    preload = c.i16() if word & PRELOAD else 0
    name = _text(c) if word & NAMED else None
    scale = c.i32() / MATRIX if word & SCALED else 1.0
    return {"index": index, "name": name, "resource": resource, "sprite": bool(word & SPRITE), "additive": bool(word & ADDITIVE), "preload_frame": preload, "time_scale": scale}


def _read_change(c: Cursor) -> dict:
    word = c.u16()
    out: dict = {"index": _index(c, word, MOVED)}
    turn = _matrix(c, MATRIX) if word & FULL else [c.i16() / ANGLE] if word & ROTATE else []
    out["transform"] = turn + [v / TWIP for v in c.unpack("2i" if word & LONG else "2h")]
    rect = [v / TWIP for v in c.unpack("4h")] if word & RECT else None
    out["source_rectangle"] = {"position": rect[:2], "size": rect[2:]} if rect else None
    out["color"] = [v / COLOUR for v in c.take(4)] if word & TINT else None
    out["sprite_frame_number"] = c.i16() if word & FRAME_NUMBER else None
    return out


def _read_frame(c: Cursor, version: int) -> dict:
    flags = c.u8()
    remove = [{"index": _index(c, c.u16(), LAYER)} for _ in range(_many(c))] if flags & REMOVES else []
    append = [_read_append(c, version) for _ in range(_many(c))] if flags & ADDS else []
    change = [_read_change(c) for _ in range(_many(c))] if flags & MOVES else []
    label = _text(c) if flags & LABEL else None
    command = [[_text(c), _text(c)] for _ in range(c.u8())] if flags & COMMANDS else []
    return {"label": label, "stop": bool(flags & STOP), "command": command, "remove": remove, "append": append, "change": change}


def _read_sprite(c: Cursor, version: int) -> dict:
    name = rate = None
    if version >= 4:
        name = _text(c)
        if version >= 6:
            _text(c)
        rate = c.i32() / MATRIX
    n = c.u16()
    area = list(c.unpack("2h")) if version >= 5 else None
    return {"name": name, "frame_rate": rate, "work_area": area, "frame": [_read_frame(c, version) for _ in range(n)]}


def decode(data: bytes) -> dict:
    c = Cursor(data)
    if c.u32() != MAGIC:
        raise FormatError("not an animation")
    version = c.i32()
    if not 1 <= version <= 6:
        raise FormatError(f"version {version}")
    out: dict = {"version": version, "frame_rate": c.u8(), "position": [v / TWIP for v in c.unpack("2h")], "size": [v / TWIP for v in c.unpack("2H")]}
    out["image"] = [_read_image(c, version) for _ in range(c.u16())]
    out["sprite"] = [_read_sprite(c, version) for _ in range(c.u16())]
    out["main_sprite"] = _read_sprite(c, version) if version <= 3 or c.u8() else None
    return out


def _fixed(value: float, scale: float, low: int, high: int) -> int:
    """Rounded half away from zero and held within the type, as saturating casts do."""
    v = value * scale
    return 0 if math.isnan(v) else max(low, min(high, int(math.copysign(math.floor(abs(v) + 0.5), v)) if math.isfinite(v) else (high if v > 0 else low)))


def _i16(value: float, scale: float) -> int:
    return _fixed(value, scale, -(1 << 15), (1 << 15) - 1)


def _i32(value: float, scale: float) -> int:
    return _fixed(value, scale, -(1 << 31), (1 << 31) - 1)


class _Encoder(Writer):
    def __init__(self, version: int) -> None:
        super().__init__()
        self.version = version

    def text(self, x: str) -> None:
        raw = x.encode()
        self.put("H", len(raw))
        self.raw(raw)

    def many(self, n: int) -> None:
        if n < 255:
            self.put("B", n)
        else:
            self.put("BH", 255, n)

    def need(self, row: dict, name: str):
        if row.get(name) is None:
            raise FormatError(f"version {self.version} needs {name}")
        return row[name]

    def index(self, n: int, flags: int, mask: int) -> None:
        self.put("H", flags | min(n, mask))
        if n >= mask:
            self.put("i", n)

    def matrix(self, t: list[float], scale: float) -> None:
        self.put("4i", *(_i32(t[p], scale) for p in _WIRE))

    def image(self, image: dict) -> None:
        self.text(image["name"])
        if self.version >= 4:
            self.put("2h", *self.need(image, "size"))
        t = image["transform"]
        if len(t) != (3 if self.version == 1 else 6):
            raise FormatError(f"a transform of {len(t)} numbers")
        if self.version == 1:
            self.put("h", _i16(t[0], ANGLE))
        else:
            self.matrix(t, IMAGE_MATRIX)
        self.put("2h", *(_i16(v, TWIP) for v in t[-2:]))

    def append(self, a: dict) -> None:
        scale, preload = a.get("time_scale", 1.0), a.get("preload_frame", 0)
        scaled = abs(scale - 1.0) > 0.0001
        flags = SPRITE * bool(a.get("sprite")) | ADDITIVE * bool(a.get("additive")) | PRELOAD * bool(preload) | NAMED * (a.get("name") is not None) | SCALED * scaled
        self.index(a["index"], flags, LAYER)
        if self.version >= 6 and a["resource"] >= 255:
            self.put("BH", 255, a["resource"])
        else:
            self.put("B", a["resource"])
        if preload:
            self.put("h", preload)
        if a.get("name") is not None:
            self.text(a["name"])
        if scaled:
            self.put("i", _i32(scale, MATRIX))

    def change(self, m: dict) -> None:
        t, rect, tint, number = m["transform"], m.get("source_rectangle"), m.get("color"), m.get("sprite_frame_number")
        full, turned = len(t) >= 6, 3 <= len(t) < 6 and abs(t[0]) > 2.0**-52
        flags = FULL * full | ROTATE * turned | RECT * (rect is not None) | TINT * (tint is not None) | FRAME_NUMBER * (number is not None) | LONG
        self.index(m["index"], flags, MOVED)
        if full:
            self.matrix(t, MATRIX)
        elif turned:
            self.put("h", _i16(t[0], ANGLE))
        self.put("2i", *(_i32(v, TWIP) for v in (t[-2:] if len(t) >= 2 else (0.0, 0.0))))
        if rect is not None:
            self.put("4h", *(_i16(v, TWIP) for v in (*rect["position"], *rect["size"])))
        if tint is not None:
            self.put("4B", *(_fixed(v, COLOUR, 0, 255) for v in tint))
        if number is not None:
            self.put("h", number)

    def frame(self, f: dict) -> None:
        parts = ((f.get("remove") or [], REMOVES), (f.get("append") or [], ADDS), (f.get("change") or [], MOVES), (f.get("command") or [], COMMANDS))
        self.put("B", sum(bit for rows, bit in parts if rows) | LABEL * (f.get("label") is not None) | STOP * bool(f.get("stop")))
        remove, append, change, command = (rows for rows, _ in parts)
        for rows, one in ((remove, lambda r: self.index(r["index"], 0, LAYER)), (append, self.append), (change, self.change)):
            if rows:
                self.many(len(rows))
                for r in rows:
                    one(r)
        if f.get("label") is not None:
            self.text(f["label"])
        if command:
            self.put("B", len(command))
            for a, b in command:
                self.text(a)
                self.text(b)

    def sprite(self, s: dict) -> None:
        if self.version >= 4:
            self.text(self.need(s, "name"))
            if self.version >= 6:
                self.text("")
            self.put("i", _i32(self.need(s, "frame_rate"), MATRIX))
        self.put("H", len(s["frame"]))
        if self.version >= 5:
            self.put("2h", *self.need(s, "work_area"))
        for f in s["frame"]:
            self.frame(f)


def encode(animation: dict) -> bytes:
    version = animation["version"]
    if not 1 <= version <= 6:
        raise FormatError(f"version {version}")
    w = _Encoder(version)
    w.put("IIB", MAGIC, version, animation["frame_rate"])
    w.put("2h", *(_i16(v, TWIP) for v in animation["position"]))
    w.put("2H", *(_fixed(v, TWIP, 0, 65535) for v in animation["size"]))
    w.put("H", len(animation["image"]))
    for image in animation["image"]:
        w.image(image)
    w.put("H", len(animation["sprite"]))
    for sprite in animation["sprite"]:
        w.sprite(sprite)
    main = animation.get("main_sprite")
    if version > 3:
        w.put("B", main is not None)
    elif main is None:
        raise FormatError(f"version {version} needs main_sprite")
    if main is not None:
        w.sprite(main)
    return w.done()


def events(animation: dict) -> list[dict]:
    """(sprite, frame, op, index, ...): what each frame does, as rows; the main sprite comes last."""
    out = []
    sprites = animation["sprite"] + ([animation["main_sprite"]] if animation["main_sprite"] else [])
    for s, sprite in enumerate(sprites):
        for n, frame in enumerate(sprite["frame"]):
            for op in ("remove", "append", "change"):
                for r in frame[op]:
                    out.append({"sprite": s, "frame": n, "op": op, "index": r["index"], "resource": r.get("resource"), "transform": r.get("transform"), "color": r.get("color"), "name": r.get("name")})
            if frame["label"] is not None or frame["stop"]:
                out.append({"sprite": s, "frame": n, "op": "stop" if frame["stop"] else "label", "index": None, "resource": None, "transform": None, "color": None, "name": frame["label"]})
    return out
