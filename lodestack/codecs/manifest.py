"""Resource manifests: composite groups of subgroups, simple groups of resources. Numbers that mean "none" come out as None."""

from __future__ import annotations

import json

from .binary import Cursor, FormatError, Writer

#: Kinds of groups and resources, and the coordinate that is none.
COMPOSITE, SIMPLE = 1, 2
TYPES = ("Image", "PopAnim", "SoundBank", "File", "PrimeFont", "RenderEffect", "DecodedSoundBank")
NO_COORDINATE = (1 << 31) - 1
#: (field, what the wire says for none): 0, 1 or the coordinate that is none.
_NUMBERS = (("width", 0), ("height", 0), ("x", NO_COORDINATE), ("y", NO_COORDINATE), ("ax", 0), ("ay", 0), ("aw", 0), ("ah", 0), ("cols", 1), ("rows", 1))
#: Bytes and rows that a manifest may ask for.
LIMIT_BYTES, LIMIT_ROWS = 512 << 20, 4_000_000


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.c, self.rows, self.text_bytes = Cursor(data), 0, 0

    def count(self) -> int:
        n = self.c.i32()
        if n < 0:
            raise FormatError("a count below zero")
        self.rows += n
        if self.rows > LIMIT_ROWS:
            raise FormatError("too many rows")
        return n

    def number(self, none: int | None = None) -> int | None:
        n = self.c.i32()
        if n < 0 and none != NO_COORDINATE:
            raise FormatError("a number below zero")
        return None if n == none else n

    def flag(self) -> bool:
        n = self.c.u8()
        if n > 1:
            raise FormatError(f"a flag of {n}")
        return bool(n)

    def text(self) -> str:
        n = self.c.i32()
        self.text_bytes += n
        if n < 0 or self.text_bytes > LIMIT_BYTES:
            raise FormatError("a string's length is out of range")
        try:
            return self.c.take(n).decode("utf-8")
        except UnicodeDecodeError as error:
            raise FormatError(str(error)) from error

    def resource(self) -> dict:
        kind = self.c.u8()
        if not 1 <= kind <= len(TYPES):
            raise FormatError(f"no resource has the type {kind}")
        row = {"type": TYPES[kind - 1], "slot": self.number()} | {k: self.number(none) for k, none in _NUMBERS}
        row["atlas"] = self.flag()
        has = [self.flag() for _ in range(3)]
        if not (has[0] and has[1]):
            raise FormatError("a resource without id or path")
        row["id"], row["path"] = self.text(), self.text()
        row["parent"] = self.text() if has[2] else None
        return row

    def group(self) -> dict:
        kind, resolution = self.c.u8(), self.number(0)
        if kind not in (COMPOSITE, SIMPLE):
            raise FormatError(f"no group has the kind {kind}")
        subgroups, resources = self.count(), self.count()
        has_id, has_parent = self.flag(), self.flag()
        if not has_id:
            raise FormatError("a group without id")
        row = {"kind": "composite" if kind == COMPOSITE else "simple", "id": self.text(), "resolution": resolution, "parent": self.text() if has_parent else None}
        if kind == COMPOSITE and resources or kind == SIMPLE and subgroups:
            raise FormatError(f"{row['id']}: members of the other kind")
        row["subgroups"] = [{"resolution": self.number(0), "id": self.text()} for _ in range(subgroups)]
        row["resources"] = [self.resource() for _ in range(resources)]
        return row


def decode(data: bytes) -> dict:
    """slot_count and groups. An error says in which group it happened."""
    r = _Reader(data)
    slots = r.number()
    groups = []
    for k in range(r.count()):
        try:
            groups.append(r.group())
        except FormatError as error:
            raise FormatError(f"group {k}: {error}") from error
    if r.c.left:
        raise FormatError(f"{r.c.left} bytes after the manifest")
    return {"slot_count": slots, "groups": groups}


def is_sprite(resource: dict) -> bool:
    return resource["type"] == "Image" and resource.get("parent") is not None


def encode(manifest: dict) -> bytes:
    w = Writer()

    def text(x: str) -> None:
        raw = x.encode()
        w.put("i", len(raw))
        w.raw(raw)

    w.put("ii", manifest["slot_count"], len(manifest["groups"]))
    for g in manifest["groups"]:
        composite = g["kind"] == "composite"
        subgroups, resources = (g["subgroups"], []) if composite else ([], g["resources"])
        w.put("BiiiBB", COMPOSITE if composite else SIMPLE, g.get("resolution") or 0, len(subgroups), len(resources), 1, g.get("parent") is not None)
        text(g["id"])
        if g.get("parent") is not None:
            text(g["parent"])
        for s in subgroups:
            w.put("i", s.get("resolution") or 0)
            text(s["id"])
        for r in resources:
            # a sprite's missing coordinate is 0, any other's is the one that is none
            numbers = [(0 if none == NO_COORDINATE and is_sprite(r) else none) if r.get(k) is None else r[k] for k, none in _NUMBERS]
            if r["slot"] < 0 or any(n < 0 for n, (_, none) in zip(numbers, _NUMBERS) if none != NO_COORDINATE):
                raise FormatError(f"{r['id']}: a number below zero")
            w.put("Bi10i4B", TYPES.index(r["type"]) + 1, r["slot"], *numbers, bool(r.get("atlas")), 1, 1, r.get("parent") is not None)
            text(r["id"])
            text(r["path"])
            if r.get("parent") is not None:
                text(r["parent"])
    return w.done()


def tables(manifest: dict) -> dict[str, list[dict]]:
    """groups, subgroups and resources as rows, with their ordinals."""
    out: dict[str, list[dict]] = {"groups": [], "subgroups": [], "resources": []}
    for i, g in enumerate(manifest["groups"]):
        out["groups"].append({"group_index": i} | {k: g[k] for k in ("kind", "id", "resolution", "parent")})
        out["subgroups"] += [{"group_index": i, "ordinal": k} | s for k, s in enumerate(g["subgroups"])]
        out["resources"] += [{"group_index": i, "resource_index": k} | r for k, r in enumerate(g["resources"])]
    return out


def to_json(manifest: dict) -> str:
    """Without what is none, as the format's tools write it."""
    def trimmed(x):
        if isinstance(x, dict):
            return {k: trimmed(v) for k, v in x.items() if v is not None and v is not False}
        return [trimmed(v) for v in x] if isinstance(x, list) else x

    return json.dumps(trimmed(manifest), indent=2, ensure_ascii=False)
