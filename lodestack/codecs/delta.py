"""Byte deltas in the format of RFC 3284, with its interleaved and checksummed extension, and deltas between bundles."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict

from . import bundle
from .binary import Cursor, FormatError, Writer
from .wrappers import inflate

#: Fixed values of the formats.
MAGIC = b"\xd6\xc3\xc4"
STANDARD, EXTENDED = 0, ord("S")
SOURCE, TARGET, CHECKSUM = 1, 2, 4
ADD, RUN, COPY = 1, 2, 3
NEAR, SAME = 4, 3
BLOCK, MOST_MATCHES, MINIMUM = 16, 64, 32
PATCH_MAGIC, PATCH_VERSION, PACKAGE, NAME_BYTES = b"PBSR", 1, 2, 128
LIMIT = 0x7FFFFFFF

Instruction = tuple[int, int, int]  # kind, size (0: it follows), mode


def _default_table() -> list[list[Instruction]]:
    """The RFC's code table, from its rules."""
    table: list[list[Instruction]] = [[(RUN, 0, 0)]]
    table += [[(ADD, n, 0)] for n in range(18)]
    table += [[(COPY, n, mode)] for mode in range(9) for n in (0, *range(4, 19))]
    table += [[(ADD, a, 0), (COPY, n, mode)] for mode in range(6) for a in range(1, 5) for n in range(4, 7)]
    table += [[(ADD, a, 0), (COPY, 4, mode)] for mode in range(6, 9) for a in range(1, 5)]
    table += [[(COPY, 4, mode), (ADD, 1, 0)] for mode in range(9)]
    return table


TABLE = _default_table()
_SINGLE = {t[0]: code for code, t in reversed(list(enumerate(TABLE))) if len(t) == 1}
_PAIR = {(_SINGLE[t[0]], t[1]): code for code, t in enumerate(TABLE) if len(t) == 2}


def put_number(out: bytearray, n: int) -> None:
    """Seven bits a byte, highest first."""
    part = [n & 0x7F]
    while n := n >> 7:
        part.append(n & 0x7F | 0x80)
    out += bytes(reversed(part))


def _number(c: Cursor) -> int:
    n = 0
    for _ in range(10):
        b = c.u8()
        n = n << 7 | b & 0x7F
        if b < 0x80:
            if n >> 64:
                break
            return n
    raise FormatError("a number is too long")


class _Addresses:
    """The caches of recent addresses that both sides keep."""

    def __init__(self, near: int = NEAR, same: int = SAME) -> None:
        self.near, self.same, self.next = [0] * near, [0] * (256 * same), 0

    def remember(self, address: int) -> None:
        if self.near:
            self.near[self.next] = address
            self.next = (self.next + 1) % len(self.near)
        if self.same:
            self.same[address % len(self.same)] = address

    def decode(self, mode: int, read, here: int) -> int:
        first_same = 2 + len(self.near)
        if mode >= first_same:
            at = 256 * (mode - first_same) + read(True)
            if at >= len(self.same):
                raise FormatError(f"copy mode {mode}")
            address = self.same[at]
        else:
            n = read(False)
            address = n if mode == 0 else here - n if mode == 1 else self.near[mode - 2] + n
        if not 0 <= address < here:
            raise FormatError("a copy from outside what is there")
        self.remember(address)
        return address

    def encode(self, address: int, here: int) -> tuple[int, int]:
        """(mode, number): the same-cache if it has the address, else the smallest number, of equal ones the lowest mode."""
        slot = address % len(self.same)
        if self.same[slot] == address:
            found = 2 + len(self.near) + slot // 256, slot % 256
        else:
            ways = [(address, 0), (here - address, 1)] + [(address - n, 2 + k) for k, n in enumerate(self.near) if n <= address]
            n, mode = min(ways)
            found = mode, n
        self.remember(address)
        return found


# decoding


def _read_table(raw: bytes, near: int, same: int) -> list[list[Instruction]]:
    """A table of its own: all first kinds, second kinds, sizes and modes, 256 of each."""
    if len(raw) != 6 * 256:
        raise FormatError("a code table has 1536 bytes")
    kinds, sizes, modes = (raw[512 * k : 512 * k + 512] for k in range(3))
    table = [[(kinds[i + h], sizes[i + h], modes[i + h]) for h in (0, 256)] for i in range(256)]
    for kind, size, mode in (x for pair in table for x in pair):
        if kind > 3 or mode > near + same + 1 or kind == 0 and size or kind != COPY and mode:
            raise FormatError("a code table with an instruction that there is not")
    need = {(ADD, 0), (RUN, 0)} | {(COPY, m) for m in range(near + same + 2)}
    if need - {(k, m) for (k, s, m), (k2, _, _) in table if s == 0 and k2 == 0}:
        raise FormatError("a code table without an instruction of any size")
    return [[x for x in pair if x[0]] for pair in table]


def _write_table(table: list[list[Instruction]]) -> bytes:
    full = [[*t, (0, 0, 0), (0, 0, 0)][:2] for t in table]
    return bytes(full[i][h][k] for k in range(3) for h in (0, 1) for i in range(256))


def _window(source: bytes, size: int, data: Cursor, code: Cursor, places: Cursor, table, caches: _Addresses) -> bytes:
    out = bytearray()
    while len(out) < size:
        for kind, n, mode in table[code.u8()]:
            n = n or _number(code)
            if not n or len(out) + n > size:
                raise FormatError("an instruction that does not fit its window")
            if kind == ADD:
                out += data.take(n)
            elif kind == RUN:
                out += data.take(1) * n
            else:
                at = caches.decode(mode, lambda byte: places.u8() if byte else _number(places), len(source) + len(out))
                if at < len(source):
                    part = source[at : at + n]
                    out += part
                    n, at = n - len(part), len(source)
                at -= len(source)
                while n > 0:  # what is being written may be part of what is copied
                    part = out[at : at + n]
                    out += part
                    at, n = at + len(part), n - len(part)
    for c in (data, code, places):
        if c.left:
            raise FormatError("a section is not used up")
    return bytes(out)


def _decode(source: bytes, c: Cursor, limit: int, planned: int | None, depth: int) -> bytes:
    if depth > 8:
        raise FormatError("code tables within code tables")
    if c.take(3) != MAGIC:
        raise FormatError("not a delta")
    version, header = c.u8(), c.u8()
    if version not in (STANDARD, EXTENDED) or header & ~2:
        raise FormatError(f"version {version}, header {header}")
    table, near, same = TABLE, NEAR, SAME
    if header & 2:
        near, same = _number(c), _number(c)
        if near + same > 254:
            raise FormatError("caches too large")
        table = _read_table(_decode(_write_table(TABLE), c, 6 * 256, 6 * 256, depth + 1), near, same)
    out = bytearray()
    while c.left if planned is None else len(out) < planned:
        flags = c.u8()
        if flags & ~(SOURCE | TARGET | (CHECKSUM if version == EXTENDED else 0)) or flags & 3 == 3:
            raise FormatError(f"window flags {flags}")
        segment = b""
        if flags & 3:
            size, at = _number(c), _number(c)
            whole = source if flags & SOURCE else bytes(out)
            if at + size > len(whole):
                raise FormatError("a window's source lies outside")
            segment = whole[at : at + size]
        w = Cursor(c.take(_number(c)))
        size = _number(w)
        if len(out) + size > min(limit, limit if planned is None else planned):
            raise FormatError(f"more than {limit} bytes")
        if w.u8():
            raise FormatError("a compressed window")
        sizes = [_number(w) for _ in range(3)]
        checksum = _number(w) if flags & CHECKSUM else None
        data, code, places = (Cursor(w.take(n)) for n in sizes)
        if w.left:
            raise FormatError("bytes after a window")
        if version == EXTENDED and not sizes[0] and not sizes[2]:
            data = places = code  # interleaved
        part = _window(segment, size, data, code, places, table, _Addresses(near, same))
        if checksum is not None and zlib.adler32(part) != checksum:
            raise FormatError("a window's checksum differs")
        out += part
    return bytes(out)


def decode(source: bytes, delta: bytes, limit: int = LIMIT) -> bytes:
    c = Cursor(delta)
    out = _decode(source, c, limit, None, 0)
    return out


# encoding


def _common(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """How many bytes from i and j on are equal, at most ``most``."""
    n, step = 0, 32
    while n < most:
        k = min(step, most - n)
        if a[i + n : i + n + k] == b[j + n : j + n + k]:
            n, step = n + k, 2 * step
        elif k == 1:
            break
        else:
            step = max(1, k // 2)
            most = n + k - 1
    return n


def _common_before(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    n = 0
    while n < most and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


class _Blocks:
    """The aligned blocks of a text seen so far, by their bytes, in order."""

    def __init__(self, data: bytes, base: int) -> None:
        self.data, self.base, self.seen = data, base, 0
        self.at: dict[bytes, list[int]] = defaultdict(list)

    def add_through(self, end: int) -> None:
        data, at = self.data, self.at
        places = range(self.seen, min(end, len(data) - BLOCK + 1), BLOCK)
        for place in places:
            at[data[place : place + BLOCK]].append(place)
        self.seen += BLOCK * len(places)

    def longest(self, target: bytes, at: int, begin: int, best: tuple[int, int, int]) -> tuple[int, int, int]:
        """(size, address, start in target) of the longest match that grows from one of the first ``MOST_MATCHES`` equal blocks; ``best`` where none is longer."""
        data, most = self.data, len(target) - begin
        for place in self.at.get(target[at : at + BLOCK], ())[:MOST_MATCHES]:
            if best[0] == most:
                break
            room = min(len(data) - place, len(target) - at) - BLOCK
            if BLOCK + min(place, at - begin) + room <= best[0]:
                continue
            left = _common_before(data, place, target, at, min(place, at - begin))
            i, j, need = place + BLOCK, at + BLOCK, max(0, best[0] + 1 - BLOCK - left)
            # a match that is no longer than the best one so far is seen in one comparison
            if need <= room and data[i : i + need] == target[j : j + need]:
                right = need + _common(data, i + need, target, j + need, room - need)
                best = max(best, (BLOCK + left + right, self.base + place - left, at - left), key=lambda m: m[0])
        return best


def operations(source: bytes, target: bytes, minimum: int = MINIMUM) -> list[tuple]:
    """("add", bytes) and ("copy", address, size) that make the target. At each place the longest match wins, of equal ones the first."""
    out: list[tuple] = []
    known, own = _Blocks(source, 0), _Blocks(target, len(source))
    known.add_through(len(source))
    begin = at = 0
    while at + BLOCK <= len(target):
        best = own.longest(target, at, begin, known.longest(target, at, begin, (0, 0, 0)))
        if best[0] >= minimum:
            size, address, start = best
            if start > begin:
                out.append(("add", target[begin:start]))
            out.append(("copy", address, size))
            begin = at = start + size
            own.add_through(begin)
        else:
            if at == own.seen:
                own.add_through(at + 1)
            at += 1
    if begin < len(target):
        out.append(("add", target[begin:]))
    return out


def encode(source: bytes, target: bytes, interleaved: bool = True, minimum: int = MINIMUM) -> bytes:
    """One window over the whole source. Two instructions share a code where the table has one for both."""
    if minimum < BLOCK:
        raise FormatError(f"matches have at least {BLOCK} bytes")
    if len(source) + len(target) > LIMIT:
        raise FormatError("too long for a delta")
    head = MAGIC + bytes([EXTENDED if interleaved else STANDARD, 0])
    if not target:
        return head
    code, data, places = bytearray(), bytearray(), bytearray()
    if interleaved:
        data = places = code
    caches, here, last = _Addresses(), len(source), None

    def instruct(kind: int, size: int, mode: int) -> None:
        nonlocal last
        if last is not None:
            for n in (size, 0):
                if (pair := _PAIR.get((code[last], (kind, n, mode)))) is not None:
                    code[last] = pair
                    if n == 0:
                        put_number(code, size)
                    last = None
                    return
        last = len(code)
        single = _SINGLE.get((kind, size, mode))
        code.append(_SINGLE[kind, 0, mode] if single is None else single)
        if single is None:
            put_number(code, size)

    for op in operations(source, target, minimum):
        if op[0] == "add":
            instruct(ADD, len(op[1]), 0)
            data += op[1]
            here += len(op[1])
        else:
            mode, n = caches.encode(op[1], here)
            instruct(COPY, op[2], mode)
            if mode >= 2 + NEAR:
                places.append(n)
            else:
                put_number(places, n)
            here += op[2]
    body = bytearray()
    put_number(body, len(target))
    body.append(0)
    sections = (b"", code, b"") if interleaved else (data, code, places)
    for s in sections:
        put_number(body, len(s))
    for s in sections:
        body += s
    out = bytearray(head)
    out.append(SOURCE)
    for n in (len(source), 0, len(body)):
        put_number(out, n)
    return bytes(out + body)


# deltas between bundles


def raw_packet(packet: bytes) -> bytes:
    """A packet with both sections unpacked, each beginning at a page."""
    if not packet:
        return packet
    head = bundle.read_packet_head(packet)
    if head["version"] != 4:
        raise FormatError("raw deltas take packets of version 4")
    out = bytearray(Cursor(packet).take(head["file_offset"]))
    for part, bit in ((0, 2), (1, 1)):
        out += bytes(bundle.aligned(len(out)) - len(out))
        size = head[f"part{part}_size"]
        if size:
            stored = Cursor(packet, head[f"part{part}_offset"]).take(head[f"part{part}_stored"])
            if not head["flags"] & bit and len(stored) < size:
                raise FormatError("a section is cut off")
            out += inflate(stored, size) if head["flags"] & bit else stored[:size]
    return bytes(out + bytes(bundle.aligned(len(out)) - len(out)))


def stored_packet(raw: bytes) -> bytes:
    """The packet again, from its unpacked form; level 9."""
    head = bundle.read_packet_head(raw)
    out = bytearray(Cursor(raw).take(head["file_offset"]))
    out += bytes(bundle.aligned(len(out)) - len(out))
    at, places = bundle.aligned(head["file_offset"]), []
    for part, bit in ((0, 2), (1, 1)):
        section = Cursor(raw, at).take(head[f"part{part}_size"])
        at = bundle.aligned(at + len(section))
        if head["flags"] & bit and (part == 0 or section):
            section = zlib.compress(section, 9)
            section += bytes(bundle.aligned(len(section)) - len(section))
        places.append((len(out), len(section)))
        out += section
    for place, values in ((24, places[0]), (40, places[1])):
        struct.pack_into("<2I", out, place, *values)
    return bytes(out)


def _views(data: bytes) -> tuple[bytes, list[dict], int]:
    head = bundle.read_head(data)
    if head["version"] != 4:
        raise FormatError("deltas take bundles of version 4")
    information = Cursor(data).take(head["information_size"])
    packets = bundle.read_packet_table(data, head)
    return information, packets, max(head["information_size"], bundle.archive_end(packets))


def _by_name(packets: list[dict]) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for p in packets:
        if p["name"] in out:
            raise FormatError(f"two packets have the name {p['name']}")
        out[p["name"]] = p
    return out


def create_patch(before: bytes, after: bytes, raw: bool = False) -> dict:
    """size, before_md5, patch (of the tables; None where equal) and packets (name, before_md5, patch). A packet that is new differs from nothing; one that is gone is not named."""
    old_information, old_packets, _ = _views(before)
    information, packets, end = _views(after)
    old = _by_name(old_packets)
    shape = raw_packet if raw else bytes

    def one(a: bytes, b: bytes) -> dict:
        return {"before_md5": hashlib.md5(a).digest(), "patch": None if a == b else encode(a, b)}

    return {"size": end} | one(old_information, information) | {
        "packets": [{"name": p["name"]} | one(shape(bundle.packet_bytes(before, old[p["name"]]) if p["name"] in old else b""), shape(bundle.packet_bytes(after, p))) for p in packets]
    }


def _applied(what: str, before: bytes, step: dict, limit: int) -> bytes:
    if hashlib.md5(before).digest() != step["before_md5"]:
        raise FormatError(f"{what}: not what the delta was made from")
    return before if step["patch"] is None else decode(before, step["patch"], limit)


def apply_patch(before: bytes, patch: dict, raw: bool = False, limit: int = LIMIT) -> bytes:
    old_information, old_packets, _ = _views(before)
    old = _by_name(old_packets)
    information = _applied("tables", old_information, patch, limit)
    head = bundle.read_head(information)
    packets = bundle.read_packet_table(information, head)
    if len(packets) != len(patch["packets"]):
        raise FormatError(f"{len(patch['packets'])} packets in the delta, {len(packets)} in its tables")
    out = bytearray(information)
    for k, (step, packet) in enumerate(zip(patch["packets"], packets)):
        if step["name"].lower() != packet["name"].lower():
            raise FormatError(f"packet {k} is {step['name']} in the delta, {packet['name']} in its tables")
        stored = bundle.packet_bytes(before, old[step["name"]]) if step["name"] in old else b""
        new = _applied(step["name"], raw_packet(stored) if raw else stored, step, limit)
        if raw:
            new = stored_packet(new)
            at = head["packet_offset"] + k * head["packet_size"]
            struct.pack_into("<2I", out, at + 128, len(out), len(new))
            out[at + 140 : at + 172] = new[16:48]
        elif len(new) != packet["length"]:
            raise FormatError(f"{step['name']}: {len(new)} bytes, {packet['length']} in its tables")
        else:
            out += bytes(max(0, packet["offset"] - len(out)) if packet["length"] else 0)
        out += new
    if not raw and len(out) != patch["size"]:
        raise FormatError(f"{len(out)} bytes, {patch['size']} in the delta")
    return bytes(out)


def write_patch(patch: dict) -> bytes:
    w = Writer()
    w.raw(PATCH_MAGIC)
    w.put("5I", PATCH_VERSION, PACKAGE, patch["size"], 0, len(patch["patch"] or b""))
    w.raw(patch["before_md5"])
    w.put("2I", len(patch["packets"]), patch["patch"] is not None)
    w.raw(patch["patch"] or b"")
    for p in patch["packets"]:
        name = p["name"].encode()
        if b"\0" in name or len(name) > NAME_BYTES:
            raise FormatError("a packet's name does not fit")
        w.put(f"2I{NAME_BYTES}s", p["patch"] is not None, len(p["patch"] or b""), name)
        w.raw(p["before_md5"])
        w.raw(p["patch"] or b"")
    return w.done()


def read_patch(data: bytes, most_packets: int = 1_000_000, most_bytes: int = LIMIT) -> dict:
    c = Cursor(data)
    if c.take(4) != PATCH_MAGIC:
        raise FormatError("not a delta between bundles")
    version, package, size, reserved, length = c.unpack("5I")
    if (version, package, reserved) != (PATCH_VERSION, PACKAGE, 0):
        raise FormatError(f"version {version}")
    out: dict = {"size": size, "before_md5": c.take(16)}
    n, there = c.unpack("2I")
    if n > most_packets:
        raise FormatError(f"{n} packets")
    left = most_bytes

    def part(there: int, length: int) -> bytes | None:
        nonlocal left
        left -= length
        if there > 1 or bool(there) == (length == 0) or left < 0:
            raise FormatError("a delta that is and is not there, or is too long")
        return c.take(length) if there else None

    out["patch"], out["packets"] = part(there, length), []
    for _ in range(n):
        there, length, name = c.unpack(f"2I{NAME_BYTES}s")
        md5 = c.take(16)
        out["packets"].append({"name": name.partition(b"\0")[0].decode(), "before_md5": md5, "patch": part(there, length)})
    if c.left:
        raise FormatError(f"{c.left} bytes after the delta")
    return out
