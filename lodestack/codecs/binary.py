"""A cursor over bytes, a writer, and variable-length integers."""

from __future__ import annotations

import struct


class FormatError(ValueError):
    """The bytes are not what the format says."""


class Cursor:
    """Reads little-endian values; an end too soon is a FormatError."""

    def __init__(self, data: bytes, at: int = 0, order: str = "<") -> None:
        self.data, self.at, self.order = data, at, order

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str):
        """One value, or a tuple of them."""
        form = self.order + form
        out = struct.unpack(form, self.take(struct.calcsize(form)))
        return out[0] if len(out) == 1 else out

    def u8(self) -> int:
        return self.unpack("B")

    def u16(self) -> int:
        return self.unpack("H")

    def i16(self) -> int:
        return self.unpack("h")

    def u32(self) -> int:
        return self.unpack("I")

    def i32(self) -> int:
        return self.unpack("i")

    def u64(self) -> int:
        return self.unpack("Q")

    def f32(self) -> float:
        return self.unpack("f")

    def varint(self, bits: int = 64) -> int:
        """Seven bits a byte, lowest first; the high bit says that more follow."""
        out = shift = 0
        while True:
            b = self.u8()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                break
            shift += 7
            if shift >= 70:
                raise FormatError("a variable-length integer does not end")
        return out & ((1 << bits) - 1)

    def zigzag(self, bits: int = 64) -> int:
        n = self.varint(bits)
        return (n >> 1) ^ -(n & 1)

    def c_string(self) -> bytes:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise FormatError("a string does not end")
        out = self.take(end - self.at)
        self.at += 1
        return out

    @property
    def left(self) -> int:
        return len(self.data) - self.at


class Writer:
    """Collects little-endian values; earlier ones can be patched."""

    def __init__(self, order: str = "<") -> None:
        self.out, self.order = bytearray(), order

    def put(self, form: str, *values) -> None:
        try:
            self.out += struct.pack(self.order + form, *values)
        except struct.error as error:
            raise FormatError(f"{values} do not fit {form}") from error

    def patch(self, at: int, form: str, *values) -> None:
        raw = struct.pack(self.order + form, *values)
        self.out[at : at + len(raw)] = raw

    def raw(self, data: bytes) -> None:
        self.out += data

    def varint(self, n: int) -> None:
        while n > 0x7F:
            self.out.append(n & 0x7F | 0x80)
            n >>= 7
        self.out.append(n)

    def align(self, size: int) -> None:
        self.out += bytes(-len(self.out) % size)

    def __len__(self) -> int:
        return len(self.out)

    def done(self) -> bytes:
        return bytes(self.out)


def varint_size(n: int) -> int:
    return max(1, -(-n.bit_length() // 7))


def zigzag_of(n: int, bits: int) -> int:
    return ((n << 1) ^ (n >> (bits - 1))) & ((1 << bits) - 1)
