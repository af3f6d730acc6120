"""Wrappers around one payload: zlib containers, XOR-prefix and block ciphers, encrypted text, digests."""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

from .binary import FormatError
from .rijndael import Rijndael, key_from_seed

#: Fixed values of the formats.
ZLIB_MAGIC = 0xDEADFED4
XOR_MAGIC = b"CRYPT_RES\n\0"
XOR_LIMIT = 0x100
CIPHER_PREFIX = b"\x10\x00"
BLOCK = 24
#: Bytes that an encrypted text may unpack to.
TEXT_LIMIT = 512 << 20


def is_zlib(data: bytes) -> bool:
    return len(data) >= 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0


def inflate(data: bytes, size: int | None = None) -> bytes:
    """One zlib stream, which other bytes may follow; its size is checked if given."""
    unzip = zlib.decompressobj()
    try:
        out = unzip.decompress(data)
    except zlib.error as error:
        raise FormatError(str(error)) from error
    if not unzip.eof:
        raise FormatError("the zlib stream does not end")
    if size is not None and len(out) != size:
        raise FormatError(f"{len(out)} bytes unpacked, {size} declared")
    return out


def inspect_container(data: bytes) -> dict:
    """variant (compact or extended), header_length, raw_size, stored_size, ratio: from the header, without unpacking."""
    if len(data) < 8:
        raise FormatError("too short for a container")
    magic, second = struct.unpack_from("<II", data)
    if magic != ZLIB_MAGIC:
        raise FormatError("not a zlib container")
    if is_zlib(data[8:10]):
        variant, head, size = "compact", 8, second
    elif second == 0 and len(data) >= 16 and is_zlib(data[16:18]):
        variant, head, size = "extended", 16, struct.unpack_from("<Q", data, 8)[0]
    else:
        raise FormatError("no zlib stream where one belongs")
    stored = len(data) - head
    return {"variant": variant, "header_length": head, "raw_size": size, "stored_size": stored, "ratio": stored / size if size else 0.0}


def unwrap_container(data: bytes, limit: int | None = None) -> bytes:
    seen = inspect_container(data)
    if limit is not None and seen["raw_size"] > limit:
        raise FormatError(f"{seen['raw_size']} bytes declared, at most {limit} allowed")
    return inflate(data[seen["header_length"] :], seen["raw_size"])


def wrap_container(data: bytes, variant: str = "compact", level: int = 9) -> bytes:
    if not 0 <= level <= 9:
        raise FormatError("levels are 0 to 9")
    if variant == "compact" and len(data) >= 1 << 32:
        raise FormatError("too long for a compact container")
    head = struct.pack("<II", ZLIB_MAGIC, len(data)) if variant == "compact" else struct.pack("<QQ", ZLIB_MAGIC, len(data))
    return head + zlib.compress(data, level)


def md5_tag(data: bytes) -> str:
    return hashlib.md5(data).hexdigest().upper() + "\r\n"


def _xored(data: bytes, key: bytes) -> bytes:
    stream = (key * (len(data) // len(key) + 1))[: len(data)] if data else b""
    return (int.from_bytes(data, "big") ^ int.from_bytes(stream, "big")).to_bytes(len(data), "big")


def _checked_key(key: bytes, limit: int) -> None:
    if limit and not key:
        raise FormatError("an empty key")


def xor_wrap(data: bytes, key: bytes, limit: int = XOR_LIMIT) -> bytes:
    """The first ``limit`` bytes XORed with the key, behind a header. Shorter data stay as they are."""
    if len(data) < limit:
        return data
    _checked_key(key, limit)
    return XOR_MAGIC + struct.pack("<Q", len(data)) + _xored(data[:limit], key) + data[limit:]


def inspect_xor(data: bytes, limit: int = XOR_LIMIT) -> dict:
    head = len(XOR_MAGIC) + 8
    if len(data) < head + limit:
        return {"wrapped": False, "raw_size": len(data), "payload_size": len(data)}
    if not data.startswith(XOR_MAGIC):
        raise FormatError("not wrapped")
    raw = struct.unpack_from("<Q", data, len(XOR_MAGIC))[0]
    if raw < limit:
        raise FormatError("the declared size is below the limit")
    if raw != len(data) - head:
        raise FormatError(f"{len(data) - head} bytes of payload, {raw} declared")
    return {"wrapped": True, "raw_size": raw, "payload_size": len(data) - head}


def xor_unwrap(data: bytes, key: bytes, limit: int = XOR_LIMIT) -> bytes:
    if not inspect_xor(data, limit)["wrapped"]:
        return data
    _checked_key(key, limit)
    body = data[len(XOR_MAGIC) + 8 :]
    return _xored(body[:limit], key) + body[limit:]


def parse_key(text: str, form: str = "utf8") -> bytes:
    """A key as text, or as hexadecimal digits between which white space may stand."""
    if form == "utf8":
        return text.encode()
    digits = "".join(text.split())
    if len(digits) % 2:
        raise FormatError("an odd number of hexadecimal digits")
    return bytes.fromhex(digits)


def cipher_wrap(data: bytes, seed: str) -> bytes:
    key, iv = key_from_seed(seed)
    return CIPHER_PREFIX + Rijndael(key, BLOCK).encrypt(iv, data)


def cipher_unwrap(data: bytes, seed: str) -> bytes:
    if not data.startswith(CIPHER_PREFIX):
        raise FormatError("no cipher prefix")
    key, iv = key_from_seed(seed)
    return Rijndael(key, BLOCK).decrypt(iv, data[2:])


def _text_container(data: bytes, seed: str, allow_space: bool) -> tuple[bytes, int]:
    try:
        cipher = base64.b64decode(b"".join(data.split()) if allow_space else data, validate=True)
    except ValueError as error:
        raise FormatError(str(error)) from error
    if not cipher:
        raise FormatError("an empty text")
    if len(cipher) % BLOCK:
        raise FormatError(f"{len(cipher)} bytes are no whole blocks")
    key, iv = key_from_seed(seed)
    # the zlib stream in it ends by itself, perhaps in zero bytes of its own
    return Rijndael(key, BLOCK).decrypt(iv, cipher, strip=False), len(cipher)


def inspect_text(data: bytes, seed: str, allow_space: bool = True) -> dict:
    container, cipher = _text_container(data, seed, allow_space)
    return inspect_container(container) | {"encoded_size": len(data), "cipher_size": cipher, "container_size": len(container)}


def decode_text(data: bytes, seed: str, limit: int = TEXT_LIMIT, allow_space: bool = True) -> bytes:
    """Base64, block cipher, zlib container. The cipher's filling at the end is left behind the zlib stream."""
    container, _ = _text_container(data, seed, allow_space)
    return unwrap_container(container, limit)


def encode_text(data: bytes, seed: str, variant: str = "compact", level: int = 9) -> bytes:
    key, iv = key_from_seed(seed)
    return base64.b64encode(Rijndael(key, BLOCK).encrypt(iv, wrap_container(data, variant, level)))
