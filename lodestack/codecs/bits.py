"""Numbers of any width in a stream of bits, the lowest bit of a byte first."""

from __future__ import annotations

from .binary import FormatError


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.held, self.size, self.at = int.from_bytes(data, "little"), 8 * len(data), 0

    def read(self, width: int) -> int:
        if not 0 <= width <= 32:
            raise FormatError(f"{width} bits at once")
        if self.at + width > self.size:
            raise FormatError(f"{width} bits wanted at {self.at} of {self.size}")
        self.at += width
        return self.held >> self.at - width & ((1 << width) - 1)


class BitWriter:
    def __init__(self) -> None:
        self.held, self.size = 0, 0

    def write(self, value: int, width: int) -> None:
        if not 0 <= width <= 32 or not 0 <= value < 1 << width:
            raise FormatError(f"{value} in {width} bits")
        self.held |= value << self.size
        self.size += width

    def done(self) -> bytes:
        """The last byte's free bits are 0."""
        return self.held.to_bytes(-(-self.size // 8), "little")
