"""Sound containers: their chunks, PCM of any byte order, and block ADPCM; to and from WAV."""

from __future__ import annotations

import struct

import numpy as np

from .binary import Cursor, FormatError

#: Codec tags, the chunks that are kept, and the tables of ADPCM.
CODECS = {0x0001: "pcm", 0xFFFE: "pcm", 0xFFFF: "vorbis", 0x8311: "adpcm", 0xAAC0: "aac"}
KEPT = (b"fmt ", b"data", b"vorb", b"cue ", b"LIST", b"smpl")
BLOCK, SAMPLES = 36, 64
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
TURNS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)


def inspect(data: bytes) -> dict:
    """The format, and offset, size and declared size of each kept chunk; of chunks with one id the first counts. A file that is cut off is told apart, not refused."""
    c = Cursor(data)
    form = c.take(4)
    if form not in (b"RIFF", b"RIFX"):
        raise FormatError("not a sound container")
    order = "<" if form == b"RIFF" else ">"
    c.order = order
    declared = c.u32() + 8
    if c.take(4) != b"WAVE":
        raise FormatError("not a WAVE form")
    chunks: dict[bytes, dict] = {}
    at, end = 12, min(declared, len(data))
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from(order + "I", data, at + 4)[0]
        if name in KEPT:
            chunks.setdefault(name, {"offset": at + 8, "size": min(size, len(data) - at - 8), "declared": size})
        at += 8 + size + size % 2
    for name in (b"fmt ", b"data"):
        if name not in chunks:
            raise FormatError(f"no chunk {name.decode()!r}")
    if chunks[b"fmt "]["size"] < 16:
        raise FormatError("the format chunk is cut off")
    f = struct.unpack_from(order + "2H2I2H", data, chunks[b"fmt "]["offset"])
    out = dict(zip(("tag", "channels", "sample_rate", "byte_rate", "block_align", "bits"), f))
    if not out["channels"] or not out["sample_rate"]:
        raise FormatError("no channels or no sample rate")
    body = chunks[b"data"]
    return out | {"codec": CODECS.get(out["tag"], "unknown"), "big_endian": order == ">", "data_offset": body["offset"], "data_size": body["size"], "declared_size": body["declared"],
                  "truncated": body["size"] < body["declared"] or len(data) < declared, "chunks": {k.decode(): v for k, v in chunks.items()}}


def wav(samples: bytes, channels: int, rate: int, bits: int, tag: int = 1, extra: bytes = b"", byte_rate: int | None = None, align: int | None = None) -> bytes:
    """A container around little-endian samples."""
    align = channels * bits // 8 if align is None else align
    try:
        head = struct.pack("<2H2I2H", tag, channels, rate, rate * align if byte_rate is None else byte_rate, align, bits) + extra
    except struct.error as error:
        raise FormatError("the format does not fit its fields") from error
    return struct.pack("<4sI4s4sI", b"RIFF", 4 + 8 + len(head) + 8 + len(samples), b"WAVE", b"fmt ", len(head)) + head + struct.pack("<4sI", b"data", len(samples)) + samples


def decode_pcm(data: bytes, info: dict) -> bytes:
    raw, bits = data[info["data_offset"] : info["data_offset"] + info["data_size"]], info["bits"]
    if bits not in (8, 16, 24, 32):
        raise FormatError(f"{bits} bits a sample")
    width = bits // 8
    if len(raw) % width:
        raise FormatError("a sample is cut off")
    if info["big_endian"] and width > 1:
        raw = np.frombuffer(raw, np.uint8).reshape(-1, width)[:, ::-1].tobytes()
    return wav(raw, info["channels"], info["sample_rate"], bits)


def encode_pcm(data: bytes) -> bytes:
    """A container of PCM from a WAV file of 8, 16, 24 or 32 bits."""
    info = inspect(data)
    if info["codec"] != "pcm":
        raise FormatError("only integer PCM is taken")
    return decode_pcm(data, info)


def decode_adpcm(data: bytes, info: dict) -> bytes:
    """Blocks of 36 bytes for each channel: a first sample, a step's index, 63 nibbles. All blocks advance together, sample by sample."""
    channels = info["channels"]
    raw = np.frombuffer(data, np.uint8, info["data_size"], info["data_offset"])
    if info["block_align"] not in (0, BLOCK, BLOCK * channels):
        raise FormatError(f"a block alignment of {info['block_align']}")
    if len(raw) % (BLOCK * channels):
        raise FormatError("a block is cut off")
    blocks = raw.reshape(-1, BLOCK)
    value = np.ascontiguousarray(blocks[:, :2]).view(">i2" if info["big_endian"] else "<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), 88)
    nibbles = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], -1).reshape(len(blocks), -1).astype(np.int64)
    out = np.zeros((len(blocks), SAMPLES), np.int64)
    out[:, 0] = value
    for k in range(SAMPLES - 1):
        n = nibbles[:, k]
        delta = ((n & 7) * 2 + 1) * STEPS[index] >> 3
        value = np.clip(value + np.where(n & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + TURNS[n], 0, 88)
        out[:, k + 1] = value
    frames = out.reshape(-1, channels, SAMPLES).transpose(0, 2, 1)
    return wav(frames.astype("<i2").tobytes(), channels, info["sample_rate"], 16)


def encode_adpcm(data: bytes) -> bytes:
    """From a 16-bit WAV file. Each channel keeps its step's index from block to block; of the 16 nibbles the first that comes nearest is taken."""
    info = inspect(data)
    if info["codec"] != "pcm" or info["bits"] != 16:
        raise FormatError("only 16-bit PCM is taken")
    channels = info["channels"]
    samples = np.frombuffer(data, "<i2", info["data_size"] // 2, info["data_offset"]).astype(np.int64)
    frames = -(-len(samples) // channels)
    blocks = -(-frames // SAMPLES)
    full = np.zeros(blocks * SAMPLES * channels, np.int64)
    full[: len(samples)] = samples
    full = full.reshape(blocks, SAMPLES, channels)
    codes = np.arange(16)
    index = np.zeros(channels, np.int64)
    out = np.zeros((blocks, channels, BLOCK), np.uint8)
    for b in range(blocks):
        value = full[b, 0].copy()
        out[b, :, :2] = value.astype("<i2").view(np.uint8).reshape(channels, 2)
        out[b, :, 2] = index
        for k in range(1, SAMPLES):
            delta = ((codes & 7) * 2 + 1) * STEPS[index][:, None] >> 3
            reached = np.clip(value[:, None] + np.where(codes & 8, -delta, delta), -32768, 32767)
            n = np.abs(full[b, k][:, None] - reached).argmin(1)
            value = reached[np.arange(channels), n]
            index = np.clip(index + TURNS[n], 0, 88)
            out[b, :, 4 + (k - 1) // 2] |= (n << 4 * ((k - 1) % 2)).astype(np.uint8)
    align = BLOCK * channels
    return wav(out.tobytes(), channels, info["sample_rate"], 4, 0x8311, b"\0\0", info["sample_rate"] * align // SAMPLES, align)


def decode(data: bytes) -> bytes:
    """A WAV file of a container's sound. Vorbis and AAC need decoders that are not here."""
    info = inspect(data)
    if info["codec"] == "pcm":
        return decode_pcm(data, info)
    if info["codec"] == "adpcm":
        return decode_adpcm(data, info)
    raise FormatError(f"{info['codec']} (tag {info['tag']:#x}) is not decoded")


def extract_aac(data: bytes) -> bytes:
    """The AAC stream as it stands."""
    info = inspect(data)
    if info["codec"] != "aac":
        raise FormatError("no AAC")
    return data[info["data_offset"] : info["data_offset"] + info["data_size"]]


#: Sample rates by their index in an ADTS header and in an AudioSpecificConfig.
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def probe_adts(data: bytes) -> dict:
    """channels, sample_rate and byte_rate of an AAC stream in ADTS frames, from the headers of all its frames."""
    at = samples = 0
    first = None
    while at + 7 <= len(data):
        if data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0:
            raise FormatError(f"no frame at {at}")
        rate, channels = data[at + 2] >> 2 & 15, (data[at + 2] & 1) << 2 | data[at + 3] >> 6
        size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if rate >= len(ADTS_RATES) or size < 7:
            raise FormatError(f"a frame at {at} that can't be")
        first = first or (channels, ADTS_RATES[rate])
        samples += 1024 * ((data[at + 6] & 3) + 1)
        at += size
    if not first or not first[0]:
        raise FormatError("no frames, or no channels")
    return {"channels": first[0], "sample_rate": first[1], "byte_rate": -(-len(data) * first[1] // samples)}


def _boxes(data: bytes, at: int, end: int):
    """(type, begin, end) of the boxes side by side between two places of an MP4 file."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = Cursor(data, at + 8, ">").u64(), 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            raise FormatError(f"a box of {size} bytes at {at}")
        yield kind, at + head, at + size
        at += size


def _inside(data: bytes, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    """The first box at the end of a path of types."""
    for kind in path:
        found = next(((a, b) for k, a, b in _boxes(data, at, end) if k == kind), None)
        if found is None:
            return None
        at, end = found
    return at, end


def _specific(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """(channels, sample rate) of the AudioSpecificConfig in an ``esds`` box, where they are told."""
    c = Cursor(data[:end], at + 4, ">")

    def descriptor() -> tuple[int, int]:
        tag, size = c.u8(), 0
        for _ in range(4):
            b = c.u8()
            size = size << 7 | b & 127
            if b < 128:
                break
        return tag, c.at + size

    tag, _ = descriptor()
    if tag != 3:
        return None
    c.take(2)
    flags = c.u8()
    c.take((2 if flags & 128 else 0) + (c.u8() if flags & 64 else 0) + (2 if flags & 32 else 0))
    tag, _ = descriptor()
    if tag != 4:
        return None
    c.take(13)
    tag, stop = descriptor()
    if tag != 5:
        return None
    raw = c.take(stop - c.at)
    word, left = int.from_bytes(raw, "big"), 8 * len(raw)

    def bits(n: int) -> int:
        nonlocal left
        left -= n
        if left < 0:
            raise FormatError("an AudioSpecificConfig is cut off")
        return word >> left & ((1 << n) - 1)

    if bits(5) == 31:
        bits(6)
    index = bits(4)
    rate = bits(24) if index == 15 else ADTS_RATES[index] if index < len(ADTS_RATES) else 0
    channels = bits(4)
    return 8 if channels == 7 else channels, rate


def probe_mp4(data: bytes) -> dict:
    """channels, sample_rate and byte_rate of the first AAC track of an MP4 file; without a duration the rate is 16,000 bytes a second."""
    moov = _inside(data, 0, len(data), b"moov")
    if moov is None:
        raise FormatError("no tracks")
    for kind, at, end in _boxes(data, *moov):
        table = _inside(data, at, end, b"mdia", b"minf", b"stbl", b"stsd") if kind == b"trak" else None
        if table is None:
            continue
        entry = next(((a, b) for k, a, b in _boxes(data, table[0] + 8, table[1]) if k == b"mp4a"), None)
        if entry is None:
            continue
        c = Cursor(data[: entry[1]], entry[0] + 8, ">")
        version = c.u16()
        c.take(6)
        channels, rate = c.u16(), (c.take(6), c.u32() >> 16)[1]
        c.take({0: 0, 1: 16, 2: 36}.get(version, 0))
        if config := _inside(data, c.at, entry[1], b"esds"):
            told = _specific(data, *config) or (0, 0)
            channels, rate = told[0] or channels, told[1] or rate
        head = _inside(data, at, end, b"mdia", b"mdhd")
        scale = duration = 0
        if head:
            c = Cursor(data[: head[1]], head[0], ">")
            long = c.u8() == 1
            c.take(3 + (16 if long else 8))
            scale, duration = c.u32(), c.u64() if long else c.u32()
        if not channels or not rate:
            raise FormatError("no channels or no sample rate")
        return {"channels": channels, "sample_rate": rate, "byte_rate": -(-len(data) * scale // duration) if scale and duration else 16_000}
    raise FormatError("no AAC track")


def probe_aac(data: bytes) -> dict:
    """Of AAC in MP4, which begins with a ``ftyp`` box, or in ADTS frames."""
    return probe_mp4(data) if data[4:8] == b"ftyp" else probe_adts(data)


def wrap_aac(data: bytes, channels: int | None = None, sample_rate: int | None = None, byte_rate: int | None = None) -> bytes:
    """A container around an AAC stream as it stands. What is not given is read from the stream's own headers."""
    if channels is None or sample_rate is None:
        found = probe_aac(data)
        channels, sample_rate, byte_rate = channels or found["channels"], sample_rate or found["sample_rate"], byte_rate or found["byte_rate"]
    if channels < 1 or sample_rate < 1:
        raise FormatError("no channels or no sample rate")
    return wav(data, channels, sample_rate, 0, 0xAAC0, bytes(16), byte_rate or 16_000, 0)


def encode(data: bytes, codec: str) -> bytes:
    """From WAV, told by its first four bytes, as pcm or adpcm."""
    if data[:4] not in (b"RIFF", b"RIFX"):
        raise FormatError("not a WAV file")
    if codec not in ("pcm", "adpcm"):
        raise FormatError(f"{codec} is not encoded")
    return encode_pcm(data) if codec == "pcm" else encode_adpcm(data)
