"""Particle emitters and trails: curves of nodes, in three layouts and as XML.

A curve is a list of nodes (time, low, high, curve_type, distribution) or None.
On the wire a value of 0, a curve type of 1 and a distribution of 1 stand for
none, so those values do not survive.
"""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
import zlib
from dataclasses import dataclass

from .binary import Cursor, FormatError, Writer
from .wrappers import ZLIB_MAGIC, inflate

LIMIT_BYTES, LIMIT_COUNT = 512 << 20, 1_000_000


@dataclass(frozen=True)
class Layout:
    """Fixed values of a layout."""

    word: int
    prefix: int
    after_count: int
    mark: int
    head: int
    gap: int
    between: int
    tail: int
    field_mark: int
    field_gap: int
    image_is_text: bool


LAYOUTS = {
    "pc": Layout(1092589901, 8, 0, 0x164, 4, 188, 4, 128, 0x14, 16, True),
    "phone32": Layout(1092589901, 8, 0, 0x164, 4, 188, 4, 128, 0x14, 16, False),
    "phone64": Layout(-527264279, 12, 4, 0x2B0, 8, 376, 12, 260, 0x18, 20, False),
}
#: (field, what stands for none).
_NUMBERS = (("image_col", 0), ("image_row", 0), ("image_frames", 1), ("animated", 0), ("particle_flags", None), ("emitter_type", 1))
#: Curves in wire order: before the duration text, after it and before the fields, and after them.
FIRST = ("system_duration",)
SECOND = (
    "cross_fade_duration", "spawn_rate", "spawn_min_active", "spawn_max_active", "spawn_max_launched", "emitter_radius", "emitter_offset_x", "emitter_offset_y",
    "emitter_box_x", "emitter_box_y", "emitter_path", "emitter_skew_x", "emitter_skew_y", "particle_duration", "system_red", "system_green", "system_blue",
    "system_alpha", "system_brightness", "launch_speed", "launch_angle",
)
THIRD = (
    "particle_red", "particle_green", "particle_blue", "particle_alpha", "particle_brightness", "particle_spin_angle", "particle_spin_speed", "particle_scale",
    "particle_stretch", "collision_reflect", "collision_spin", "clip_top", "clip_bottom", "clip_left", "clip_right", "animation_rate",
)
CURVES = (*FIRST, *SECOND, *THIRD)
TRAIL_CURVES = ("width_over_length", "width_over_life", "alpha_over_length", "alpha_over_life")
#: Names of curve types from 1, of field types from 0, of emitter types from 0, and flags by bit.
CURVE_NAMES = ("Linear", "EaseIn", "EaseOut", "EaseSinWave", "EaseInOutWeak", "Bounce")
FIELD_NAMES = ("Position", "Velocity", "Acceleration", "Friction", "Shake", "Circle", "Away", "GroundConstraint", "SystemPosition")
EMITTER_NAMES = (None, "Circle", "Box", "CircleEvenSpacing")
FLAGS = {"RandomLaunchSpin": 0, "DieIfOverloaded": 5, "ParticleLoops": 3, "SystemLoops": 4, "FullScreen": 7, "Additive": 8, "HardwareOnly": 9}


def _unwrap(data: bytes) -> bytes:
    if len(data) < 4:
        raise FormatError("too short")
    if struct.unpack_from("<I", data)[0] != ZLIB_MAGIC:
        return data
    if len(data) < 8:
        raise FormatError("the container is cut off")
    size = struct.unpack_from("<I", data, 4)[0]
    if size > LIMIT_BYTES:
        raise FormatError(f"{size} bytes declared")
    return inflate(data[8:], size)


def _wrap(raw: bytes) -> bytes:
    return struct.pack("<2I", ZLIB_MAGIC, len(raw)) + zlib.compress(raw, 6)


def _count(c: Cursor) -> int:
    n = c.i32()
    if not 0 <= n <= LIMIT_COUNT:
        raise FormatError(f"a count of {n}")
    return n


def _text(c: Cursor) -> str | None:
    n = c.i32()
    if not 0 <= n <= 64 << 20:
        raise FormatError(f"a length of {n}")
    try:
        return c.take(n).rstrip(b"\0").decode() or None
    except UnicodeDecodeError as error:
        raise FormatError(str(error)) from error


def _put_text(w: Writer, x: str | None) -> None:
    raw = (x or "").encode()
    w.put("i", len(raw))
    w.raw(raw)


def _curve(c: Cursor) -> list[dict] | None:
    nodes = []
    for _ in range(_count(c)):
        time, low, high, kind, spread = c.unpack("3f2i")
        nodes.append({"time": time, "low": low or None, "high": high or None, "curve_type": None if kind == 1 else kind, "distribution": None if spread == 1 else spread})
    return nodes or None


def _put_curve(w: Writer, nodes: list[dict] | None) -> None:
    def of(value, none):
        return none if value is None else value

    w.put("i", len(nodes or ()))
    for n in nodes or ():
        w.put("3f2i", n["time"], n["low"] or 0.0, n["high"] or 0.0, of(n["curve_type"], 1), of(n["distribution"], 1))


def decode_as(data: bytes, version: str) -> list[dict]:
    k, c = LAYOUTS[version], Cursor(_unwrap(data))
    c.take(k.prefix)
    n = _count(c)
    c.take(k.after_count)
    if (mark := c.i32()) != k.mark:
        raise FormatError(f"mark {mark:#x} where {k.mark:#x} belongs")
    emitters, fields = [], []
    for _ in range(n):
        c.take(k.head)
        row = {}
        for name, none in _NUMBERS:
            value = c.i32()
            row[name] = None if none is not None and value == none else value
        c.take(k.gap)
        own = _count(c)
        c.take(k.between)
        fields.append((own, _count(c)))
        c.take(k.tail)
        emitters.append(row)
    for row, counts in zip(emitters, fields):
        if k.image_is_text:
            row["image"] = _text(c)
        else:
            image = c.i32()
            row["image"] = None if image == -1 else str(image)
        row["name"] = _text(c)
        row |= {f: _curve(c) for f in FIRST}
        row["on_duration"] = _text(c)
        row |= {f: _curve(c) for f in SECOND}
        for name, count in zip(("field", "system_field"), counts):
            if (mark := c.i32()) != k.field_mark:
                raise FormatError(f"no fields at {c.at}")
            kinds = []
            for _ in range(count):
                kinds.append(c.i32() or None)
                c.take(k.field_gap)
            row[name] = [{"field_type": kind, "x": _curve(c), "y": _curve(c)} for kind in kinds] or None
        row |= {f: _curve(c) for f in THIRD}
    return emitters


def decode(data: bytes) -> tuple[list[dict], str]:
    """The first layout that fits, in their order."""
    why = []
    for version in LAYOUTS:
        try:
            return decode_as(data, version), version
        except FormatError as error:
            why.append(f"{version}: {error}")
    raise FormatError("; ".join(why))


def encode(emitters: list[dict], version: str = "pc") -> bytes:
    k, w = LAYOUTS[version], Writer()
    w.put("i", k.word)
    w.raw(bytes(k.prefix - 4))
    w.put("i", len(emitters))
    w.raw(bytes(k.after_count))
    w.put("i", k.mark)
    for e in emitters:
        w.raw(bytes(k.head))
        for name, none in _NUMBERS:
            w.put("i", (none or 0) if e.get(name) is None else e[name])
        w.raw(bytes(k.gap))
        w.put("i", len(e.get("field") or ()))
        w.raw(bytes(k.between))
        w.put("i", len(e.get("system_field") or ()))
        w.raw(bytes(k.tail))
    for e in emitters:
        if k.image_is_text:
            _put_text(w, e.get("image"))
        else:
            try:
                w.put("i", int(e.get("image")))
            except (TypeError, ValueError):
                w.put("i", -1)
        _put_text(w, e.get("name"))
        for f in FIRST:
            _put_curve(w, e.get(f))
        _put_text(w, e.get("on_duration"))
        for f in SECOND:
            _put_curve(w, e.get(f))
        for name in ("field", "system_field"):
            rows = e.get(name) or ()
            w.put("i", k.field_mark)
            for f in rows:
                w.put("i", f["field_type"] or 0)
                w.raw(bytes(k.field_gap))
            for f in rows:
                _put_curve(w, f["x"])
                _put_curve(w, f["y"])
        for f in THIRD:
            _put_curve(w, e.get(f))
    return _wrap(w.done())


# the curve mini-language: "[low high],percent Curve", one node after the other

_TOKEN = re.compile(r"(\[[^\]]*\][^\s\[]*)|([^\s\[]+)")


def _float(text: str) -> float | None:
    try:
        return struct.unpack("<f", struct.pack("<f", float(text)))[0] if text == text.strip() and text else None
    except (ValueError, OverflowError):
        return None


def parse_curve(text: str) -> list[dict]:
    """The nodes of a curve's text. A curve's name belongs to the node before it; a plain 0 is none; times are percent."""
    nodes: list[dict] = []
    for m in _TOKEN.finditer(text.strip()):
        token = m[0]
        if token in CURVE_NAMES:
            if nodes:
                nodes[-1]["curve_type"] = CURVE_NAMES.index(token) + 1
            continue
        if token.startswith("["):
            values, _, after = token[1:].partition("]")
            parts = [_float(x) or 0.0 for x in values.split()[:2]]
            if not parts:
                continue
            low, high = parts[0], parts[-1]
            time = _float(after[1:]) if after.startswith(",") else None
        else:
            value, _, after = token.partition(",")
            low = high = _float(value) or None
            time = _float(after)
        nodes.append({"time": _float(repr((time or 0.0) / 100)), "low": low, "high": high, "curve_type": None, "distribution": None})
    return nodes


def _number(v: float) -> str:
    rounded = round(v * 1e6) / 1e6
    near = round(rounded)
    if abs(rounded - near) < 0.0001 and abs(near) < 1e7:
        return str(near)
    return f"{rounded:.6f}".rstrip("0").rstrip(".")


def format_curve(nodes: list[dict]) -> str:
    parts = []
    for n in nodes:
        low, high, percent = n["low"] or 0.0, n["high"] or 0.0, n["time"] * 100
        value = _number(low) if low == high else f"[{_number(low)} {_number(high)}]"
        parts.append(f"{value},{_number(percent)}" if percent else value)
        if (kind := n["curve_type"]) and 1 < kind <= len(CURVE_NAMES):
            parts.append(CURVE_NAMES[kind - 1])
    return " ".join(parts)


# XML


def _tag(name: str) -> str:
    return "".join(p.capitalize() for p in name.split("_"))


_BY_TAG = {_tag(c): c for c in CURVES}
_TRAIL_TAGS = {_tag(c): c for c in TRAIL_CURVES}
_INTS = {"ImageCol": "image_col", "ImageRow": "image_row", "ImageFrames": "image_frames", "Animated": "animated"}
_TEXTS = {"Name": "name", "Image": "image", "ImagePath": "image_path", "OnDuration": "on_duration"}


def _escaped(text) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def to_xml(emitters: list[dict]) -> str:
    out = []
    for e in emitters:
        def put(tag: str, value, pad: str = "  ") -> None:
            out.append(f"{pad}<{tag}>{_escaped(value)}</{tag}>\n")

        out.append("<Emitter>\n")
        if e.get("name") is not None:
            put("Name", e["name"])
        for tag, bit in FLAGS.items():
            if (e.get("particle_flags") or 0) >> bit & 1:
                put(tag, 1)
        for tag in ("Image", "ImagePath"):
            if e.get(_TEXTS[tag]) is not None:
                put(tag, e[_TEXTS[tag]])
        for tag, name in _INTS.items():
            if e.get(name):
                put(tag, e[name])
        kind = e.get("emitter_type") or 0
        if 0 < kind < len(EMITTER_NAMES):
            put("EmitterType", EMITTER_NAMES[kind])
        for name in CURVES:
            if e.get(name):
                put(_tag(name), format_curve(e[name]))
            if name == "system_duration" and e.get("on_duration") is not None:
                put("OnDuration", e["on_duration"])
        for tag, name in (("Field", "field"), ("SystemField", "system_field")):
            for f in e.get(name) or ():
                out.append(f"  <{tag}>\n")
                kind = f["field_type"] or 0
                put("FieldType", FIELD_NAMES[kind] if 0 <= kind < len(FIELD_NAMES) else FIELD_NAMES[0], "    ")
                for axis in ("x", "y"):
                    if f[axis]:
                        put(axis.upper(), format_curve(f[axis]), "    ")
                out.append(f"  </{tag}>\n")
        out.append("</Emitter>\n")
    return "".join(out)


def _root(text: str, name: str) -> ET.Element:
    try:
        return ET.fromstring(f"<{name}>{text}</{name}>")
    except ET.ParseError as error:
        raise FormatError(str(error)) from error


def _int(text: str) -> int | None:
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else None


def from_xml(text: str) -> list[dict]:
    """Emitters; tags that are not known are passed over."""
    out = []
    for node in _root(text, "Emitters").iter("Emitter"):
        e: dict = dict.fromkeys((*CURVES, *_INTS.values(), *_TEXTS.values(), "emitter_type", "field", "system_field")) | {"particle_flags": 0}
        for child in node:
            tag, value = child.tag, (child.text or "").strip()
            if tag in ("Field", "SystemField"):
                held = {x.tag: (x.text or "").strip() for x in child}
                kind = held.get("FieldType")
                row = {"field_type": None if kind is None else FIELD_NAMES.index(kind) if kind in FIELD_NAMES else 0}
                row |= {axis: parse_curve(held[axis.upper()]) if axis.upper() in held else None for axis in ("x", "y")}
                name = "field" if tag == "Field" else "system_field"
                e[name] = [*(e[name] or ()), row]
            elif tag in FLAGS:
                e["particle_flags"] |= (value == "1") << FLAGS[tag]
            elif tag in _BY_TAG:
                e[_BY_TAG[tag]] = parse_curve(value)
            elif tag in _INTS:
                e[_INTS[tag]] = _int(value)
            elif tag in _TEXTS:
                e[_TEXTS[tag]] = value
            elif tag == "EmitterType":
                e["emitter_type"] = EMITTER_NAMES.index(value) if value in EMITTER_NAMES else 0
        out.append(e)
    return out


def decode_trail(data: bytes) -> dict:
    if len(data) < 4 or struct.unpack_from("<I", data)[0] != ZLIB_MAGIC:
        raise FormatError("not a trail")
    c = Cursor(_unwrap(data))
    c.take(8)
    points, distance, flags = c.unpack("ifi")
    c.take(40)
    return {"max_points": points, "min_point_distance": distance, "trail_flags": flags, "image": _text(c)} | {f: _curve(c) for f in TRAIL_CURVES}


def encode_trail(trail: dict) -> bytes:
    w = Writer()
    w.raw(bytes(8))
    w.put("ifi", trail["max_points"], trail["min_point_distance"], trail["trail_flags"])
    w.raw(bytes(40))
    _put_text(w, trail.get("image"))
    for f in TRAIL_CURVES:
        _put_curve(w, trail.get(f))
    w.put("i", 0)
    return _wrap(w.done())


def trail_to_xml(trail: dict) -> str:
    rows = [("Image", trail["image"])] if trail.get("image") is not None else []
    rows.append(("MaxPoints", trail["max_points"]))
    rows += [("Loops", trail["trail_flags"])] if trail["trail_flags"] else []
    rows.append(("MinPointDistance", _number(trail["min_point_distance"])))
    rows += [(_tag(f), format_curve(trail[f])) for f in TRAIL_CURVES if trail.get(f)]
    return "".join(f"<{tag}>{_escaped(value)}</{tag}>\n" for tag, value in rows)


def trail_from_xml(text: str) -> dict:
    held = {x.tag: (x.text or "").strip() for x in _root(text, "Trail")}
    out: dict = {"max_points": _int(held.get("MaxPoints", "")) or 0, "min_point_distance": _float(held.get("MinPointDistance", "")) or 0.0, "trail_flags": _int(held.get("Loops", "")) or 0, "image": held.get("Image")}
    return out | {name: parse_curve(held[tag]) if tag in held else None for tag, name in _TRAIL_TAGS.items()}


def curve_rows(emitters: list[dict]) -> list[dict]:
    """(emitter, curve, node, time, low, high, curve_type, distribution); the axes of fields as field[0].x."""
    out = []
    for i, e in enumerate(emitters):
        curves = {c: e.get(c) for c in CURVES}
        for name in ("field", "system_field"):
            for k, f in enumerate(e.get(name) or ()):
                curves |= {f"{name}[{k}].{axis}": f[axis] for axis in ("x", "y")}
        for curve, nodes in curves.items():
            out += [{"emitter": i, "curve": curve, "node": n} | node for n, node in enumerate(nodes or ())]
    return out
