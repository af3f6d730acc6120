"""The Rijndael cipher with blocks of 128, 192 or 256 bits, in CBC mode, from its published description."""

from __future__ import annotations

from functools import cache


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements with x^8 + x^4 + x^3 + x + 1."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@cache
def _boxes() -> tuple[bytes, bytes]:
    """The substitution (inverse in the field, then an affine map) and its inverse."""
    power = [1]
    for _ in range(254):
        power.append(_times(power[-1], 3))
    box = bytearray(256)
    for x in range(256):
        y = power[-power.index(x) % 255] if x else 0
        z = y
        for k in range(1, 5):
            z ^= (y << k | y >> (8 - k)) & 0xFF
        box[x] = z ^ 0x63
    back = bytearray(256)
    for x, y in enumerate(box):
        back[y] = x
    return bytes(box), bytes(back)


@cache
def _products(factor: int) -> bytes:
    return bytes(_times(x, factor) for x in range(256))


#: How far the rows 1, 2, 3 of a block shift, by its columns.
_SHIFTS = {4: (1, 2, 3), 6: (1, 2, 3), 8: (1, 3, 4)}


class Rijndael:
    """One key; blocks of ``block`` bytes (16, 24 or 32)."""

    def __init__(self, key: bytes, block: int) -> None:
        if len(key) not in (16, 24, 32) or block not in (16, 24, 32):
            raise ValueError("keys and blocks have 16, 24 or 32 bytes")
        self.columns = block // 4
        words = len(key) // 4
        self.rounds = max(words, self.columns) + 6
        box, _ = _boxes()
        w = [list(key[4 * i : 4 * i + 4]) for i in range(words)]
        factor = 1
        for i in range(words, self.columns * (self.rounds + 1)):
            t = list(w[-1])
            if i % words == 0:
                t = [box[x] for x in t[1:] + t[:1]]
                t[0] ^= factor
                factor = _times(factor, 2)
            elif words > 6 and i % words == 4:
                t = [box[x] for x in t]
            w.append([a ^ b for a, b in zip(w[i - words], t)])
        size = self.columns
        self.keys = [bytes(x for word in w[r * size : (r + 1) * size] for x in word) for r in range(self.rounds + 1)]
        shifts = (0, *_SHIFTS[size])
        # place 4c + r takes what is in row r, shift columns further on
        self.forward = [4 * ((c + shifts[r]) % size) + r for c in range(size) for r in range(4)]
        self.backward = [4 * ((c - shifts[r]) % size) + r for c in range(size) for r in range(4)]

    @staticmethod
    def _mixed(state: bytes, factors: tuple[int, int, int, int]) -> bytes:
        a, b, c, d = (_products(f) for f in factors)
        out = bytearray(len(state))
        for i in range(0, len(state), 4):
            p, q, r, s = state[i : i + 4]
            out[i] = a[p] ^ b[q] ^ c[r] ^ d[s]
            out[i + 1] = d[p] ^ a[q] ^ b[r] ^ c[s]
            out[i + 2] = c[p] ^ d[q] ^ a[r] ^ b[s]
            out[i + 3] = b[p] ^ c[q] ^ d[r] ^ a[s]
        return bytes(out)

    @staticmethod
    def _xor(a: bytes, b: bytes) -> bytes:
        return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big")

    def encrypt_block(self, block: bytes) -> bytes:
        box, _ = _boxes()
        s = self._xor(block, self.keys[0])
        for r in range(1, self.rounds + 1):
            s = s.translate(box)
            s = bytes(s[i] for i in self.forward)
            if r < self.rounds:
                s = self._mixed(s, (2, 3, 1, 1))
            s = self._xor(s, self.keys[r])
        return s

    def decrypt_block(self, block: bytes) -> bytes:
        _, back = _boxes()
        s = block
        for r in range(self.rounds, 0, -1):
            s = self._xor(s, self.keys[r])
            if r < self.rounds:
                s = self._mixed(s, (14, 11, 13, 9))
            s = bytes(s[i] for i in self.backward).translate(back)
        return self._xor(s, self.keys[0])

    def encrypt(self, iv: bytes, data: bytes) -> bytes:
        """CBC; zero bytes fill the last block, a whole block of them where it is full."""
        size = 4 * self.columns
        data += bytes(size - len(data) % size)
        out, last = [], iv
        for i in range(0, len(data), size):
            last = self.encrypt_block(self._xor(data[i : i + size], last))
            out.append(last)
        return b"".join(out)

    def decrypt(self, iv: bytes, data: bytes, strip: bool = True) -> bytes:
        """Without the zero bytes at the end, at most a block of them; with ``strip`` off, all bytes, for data that know their own end."""
        size = 4 * self.columns
        if not data or len(data) % size:
            raise ValueError("the length is no multiple of the block's")
        out, last = [], iv
        for i in range(0, len(data), size):
            out.append(self._xor(self.decrypt_block(data[i : i + size]), last))
            last = data[i : i + size]
        plain = b"".join(out)
        return plain if not strip else plain[: max(len(plain.rstrip(b"\0")), len(plain) - size)]


def key_from_seed(seed: str) -> tuple[bytes, bytes]:
    """Key and start vector for 24-byte blocks: the MD5 of the seed as 32 hexadecimal digits, and the 24 of them from the fifth on."""
    import hashlib

    key = hashlib.md5(seed.encode()).hexdigest().encode()
    return key, key[4:28]
