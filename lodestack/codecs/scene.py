"""Keyframe tracks to and from an XML project of layers and frames: sparse values are filled forward into matrices, matrices are taken apart and only changes kept."""

from __future__ import annotations

import math
import struct
import xml.etree.ElementTree as ET

from .binary import FormatError
from .keyframes import FIELDS, TEXTS

#: What a track begins with.
START = {"x": 0.0, "y": 0.0, "kx": 0.0, "ky": 0.0, "sx": 1.0, "sy": 1.0, "f": 0.0, "a": 1.0}
#: Below this a value has not changed.
TOLERANCE = 0.001
DOCUMENT, LIBRARY, PROXY = "DOMDocument.xml", "library", ("main.xfl", "PROXY-CS5")
_NAMESPACE = "http://ns.adobe.com/xfl/2008/"


def _f32(v: float) -> float:
    return struct.unpack("<f", struct.pack("<f", v))[0]


def image_name(text: str) -> str:
    """An image's id without the prefix of images, in lower case."""
    prefix = "IMAGE_REANIM_"
    return text[len(prefix) :].lower() if text.startswith(prefix) else text.lower()


def compose(state: dict) -> tuple[float, float, float, float, float, float]:
    """The matrix of skews in degrees, scales and a place."""
    kx, ky = math.radians(state["kx"]), -math.radians(state["ky"])
    return math.cos(kx) * state["sx"], math.sin(kx) * state["sx"], math.sin(ky) * state["sy"], math.cos(ky) * state["sy"], state["x"], state["y"]


def decompose(a: float, b: float, c: float, d: float, x: float, y: float) -> dict:
    """Skews and scales of a matrix; each scale from whichever of cosine and sine is the larger."""
    def one(near: float, far: float) -> tuple[float, float]:
        angle = math.atan2(far, near)
        flat = abs(angle) < math.pi / 4 or abs(angle) > 3 * math.pi / 4
        return angle, near / math.cos(angle) if flat else far / math.sin(angle)

    (kx, sx), (ky, sy) = one(a, b), one(d, c)
    return {k: _f32(v) for k, v in {"x": x, "y": y, "kx": math.degrees(kx), "ky": -math.degrees(ky), "sx": sx, "sy": sy}.items()}


def filled(frames: list[dict]) -> list[dict]:
    """Each frame's whole state: the last value of every field so far."""
    state, image, out = dict(START), None, []
    for frame in frames:
        state |= {k: frame[k] for k in FIELDS if frame.get(k) is not None}
        image = image_name(frame["i"]) if frame.get("i") is not None else image
        out.append(state | {"image": image, "shown": image is not None and abs(state["f"] + 1) > TOLERANCE})
    return out


def changes(frames: list[dict]) -> list[dict]:
    """Sparse frames of parsed ones (duration, image, matrix, alpha): a value only where it differs by more than the tolerance from the last one kept; f is -1 where a track hides and 0 where it shows again."""
    held, image, hidden, out = dict(START), None, False, []
    for frame in frames:
        there = frame.get("image") is not None or frame.get("matrix") is not None
        for k in range(frame["duration"]):
            row: dict = dict.fromkeys((*FIELDS, *TEXTS))
            if there:
                if frame.get("image") is not None and frame["image"] != image:
                    row["i"] = image = frame["image"]
                values = decompose(*frame["matrix"]) if frame.get("matrix") is not None else {}
                if frame.get("alpha") is not None:
                    values["a"] = frame["alpha"]
                for name, value in values.items():
                    if abs(held[name] - value) > TOLERANCE:
                        held[name] = row[name] = value
                if frame.get("matrix") is not None and hidden and k == 0:
                    row["f"], hidden = 0.0, False
            elif not hidden and k == 0:
                row["f"], hidden = -1.0, True
            out.append(row)
    return out


def encode(animation: dict) -> dict[str, bytes]:
    """The project's files by path."""
    media: list[str] = []
    ET.register_namespace("", _NAMESPACE)
    tag = lambda name: f"{{{_NAMESPACE}}}{name}"
    root = ET.Element(tag("DOMDocument"), {"frameRate": f"{animation['fps']:.6f}", "width": "80", "height": "80", "xflVersion": "2.971"})
    layers = []
    for track in reversed(animation["tracks"]):
        layer = ET.Element(tag("DOMLayer"), {"name": track["name"]})
        frames = ET.SubElement(layer, tag("frames"))
        for n, s in enumerate(filled(track["frames"])):
            node = ET.SubElement(frames, tag("DOMFrame"), {"index": str(n)})
            elements = ET.SubElement(node, tag("elements"))
            if s["image"] is not None and s["image"] not in media:
                media.append(s["image"])
            if s["shown"]:
                item = ET.SubElement(elements, tag("DOMSymbolInstance"), {"libraryItemName": s["image"], "symbolType": "graphic", "loop": "loop"})
                names = ("a", "b", "c", "d", "tx", "ty")
                ET.SubElement(ET.SubElement(item, tag("matrix")), tag("Matrix"), {k: f"{v:.6f}" for k, v in zip(names, compose(s))})
                ET.SubElement(ET.SubElement(item, tag("color")), tag("Color"), {"alphaMultiplier": f"{s['a']:.6f}"})
        layers.append(layer)
    for kind, item in (("media", "DOMBitmapItem"), ("symbols", "Include")):
        box = ET.SubElement(root, tag(kind))
        for m in media:
            ET.SubElement(box, tag(item), {"name": f"{m}.png", "href": f"{m}.png"} if kind == "media" else {"href": f"{m}.xml"})
    timeline = ET.SubElement(ET.SubElement(root, tag("timelines")), tag("DOMTimeline"), {"name": "animation"})
    ET.SubElement(timeline, tag("layers")).extend(layers)
    out = {PROXY[0]: PROXY[1].encode(), DOCUMENT: ET.tostring(root, "utf-8")}
    for m in media:
        symbol = ET.Element(tag("DOMSymbolItem"), {"name": m, "symbolType": "graphic"})
        frame = ET.SubElement(ET.SubElement(ET.SubElement(ET.SubElement(ET.SubElement(symbol, tag("timeline")), tag("DOMTimeline"), {"name": m}), tag("layers")), tag("DOMLayer"), {"name": "1"}), tag("frames"))
        ET.SubElement(ET.SubElement(ET.SubElement(frame, tag("DOMFrame"), {"index": "0"}), tag("elements")), tag("DOMBitmapInstance"), {"libraryItemName": f"{m}.png"})
        out[f"{LIBRARY}/{m}.xml"] = ET.tostring(symbol, "utf-8")
    return out


def decode(document: bytes) -> dict:
    """The tracks of a project's document; its layers come in reverse order of the tracks."""
    try:
        root = ET.fromstring(document)
    except ET.ParseError as error:
        raise FormatError(str(error)) from error
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2]
    tracks = []
    for layer in root.iter("DOMLayer"):
        parsed = []
        for node in layer.iter("DOMFrame"):
            item = node.find(".//DOMSymbolInstance")
            matrix, colour = (None, None) if item is None else (item.find(".//Matrix"), item.find(".//Color"))
            take = lambda k, none: float(matrix.get(k, none))  # noqa: E731, B023
            parsed.append({
                "duration": int(node.get("duration", "1")),
                "image": None if item is None else item.get("libraryItemName"),
                "matrix": None if item is None else tuple(take(k, d) for k, d in zip(("a", "b", "c", "d", "tx", "ty"), (1, 0, 0, 1, 0, 0))) if matrix is not None else (1.0, 0.0, 0.0, 1.0, 0.0, 0.0),
                "alpha": None if colour is None else _f32(float(colour.get("alphaMultiplier", 1))),
            })
        tracks.append({"name": layer.get("name", ""), "frames": changes(parsed)})
    return {"fps": float(root.get("frameRate", 24)), "tracks": tracks[::-1]}
