"""Textures without a header: packed pixels in rows or tiles, and ETC1 blocks with three kinds of alpha. Images are arrays of (height, width, 4)."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .binary import FormatError

#: Format codes. Two of them stand for more than one format; the payload's length decides.
CODES = {
    0: "rgba8888", 1: "rgba4444", 2: "rgb565", 3: "rgba5551", 21: "rgba4444_tiled", 22: "rgb565_tiled", 23: "rgba5551_tiled", 30: "pvrtc4", 147: "etc1", 148: "pvrtc4_a8",
    160: "astc4x4", 161: "astc5x5", 162: "astc6x6", 163: "astc8x8", 200: "a8", 201: "l8", 202: "la88", 203: "al88", 204: "la44", 205: "al44", 206: "rgb332", 207: "rgb888",
    208: "argb8888", 209: "argb4444", 210: "argb1555",
}
#: Bits of (red, green, blue, alpha) in a little-endian word, each (shift, width); "l" fills all three colours.
_WORDS = {
    "rgba4444": (2, {"r": (12, 4), "g": (8, 4), "b": (4, 4), "a": (0, 4)}),
    "rgb565": (2, {"r": (11, 5), "g": (5, 6), "b": (0, 5)}),
    "rgba5551": (2, {"r": (11, 5), "g": (6, 5), "b": (1, 5), "a": (0, 1)}),
    "argb4444": (2, {"a": (12, 4), "r": (8, 4), "g": (4, 4), "b": (0, 4)}),
    "argb1555": (2, {"a": (15, 1), "r": (10, 5), "g": (5, 5), "b": (0, 5)}),
    "rgba8888": (4, {"r": (0, 8), "g": (8, 8), "b": (16, 8), "a": (24, 8)}),
    "argb8888": (4, {"b": (0, 8), "g": (8, 8), "r": (16, 8), "a": (24, 8)}),
    "rgb888": (3, {"r": (0, 8), "g": (8, 8), "b": (16, 8)}),
    "rgb332": (1, {"r": (5, 3), "g": (2, 3), "b": (0, 2)}),
    "a8": (1, {"a": (0, 8)}),
    "l8": (1, {"l": (0, 8)}),
    "la88": (2, {"l": (0, 8), "a": (8, 8)}),
    "al88": (2, {"a": (0, 8), "l": (8, 8)}),
    "la44": (1, {"a": (4, 4), "l": (0, 4)}),
    "al44": (1, {"l": (4, 4), "a": (0, 4)}),
}
TILE = 32
#: The brightness steps of ETC1.
_STEPS = np.array([[2, 8], [5, 17], [9, 29], [13, 42], [18, 60], [24, 80], [33, 106], [47, 183]])


def _etc1_size(width: int, height: int) -> int:
    return -(-width // 4) * -(-height // 4) * 8


def _pvrtc_size(width: int, height: int) -> int:
    if min(width, height) < 4 or width & (width - 1) or height & (height - 1):
        raise FormatError(f"PVRTC has sides of powers of two from 4 on, not {width} x {height}")
    return width * height // 2


def payload_size(form: str, width: int, height: int, pitch: int | None = None, data: bytes | None = None) -> int:
    """How many bytes an image has. A palette's length is read from ``data`` if given."""
    if width <= 0 or height <= 0:
        raise FormatError("an empty texture")
    base = form.removesuffix("_tiled")
    if form.endswith("_tiled"):
        return -(-width // TILE) * -(-height // TILE) * TILE * TILE * _WORDS[base][0]
    if form in _WORDS:
        least = width * _WORDS[form][0]
        if pitch and pitch < least:
            raise FormatError(f"a pitch of {pitch}, at least {least} needed")
        return (pitch or least) * height
    if form.startswith("astc"):
        side = int(form[4])
        return -(-width // side) * -(-height // side) * 16
    if form.startswith("pvrtc4"):
        return _pvrtc_size(width, height) + (width * height if form.endswith("a8") else 0)
    colour = _etc1_size(width, height)
    if form == "etc1":
        return colour
    if form == "etc1_a8":
        return colour + width * height
    if form == "etc1_alpha":
        return 2 * colour
    if form == "etc1_palette":
        if data is None:
            return colour + 17 + -(-width * height // 2)
        if len(data) <= colour:
            raise FormatError("no palette")
        count = data[colour]
        depth = (count - 1).bit_length() if count else 1
        return colour + 1 + count + -(-width * height * depth // 8)
    raise FormatError(f"no format {form}")


def resolve(code: int, width: int, height: int, length: int | None = None, alpha_size: int | None = None, data: bytes | None = None, pitch: int | None = None) -> str:
    """The format of a code. Codes 30 and 147 take the first of their formats whose layout has the payload's length, beginning with a palette if an alpha size is given."""
    if code not in CODES:
        raise FormatError(f"format code {code}")
    if code not in (30, 147):
        return CODES[code]
    choices = ["pvrtc4"] if code == 30 else ["etc1", "etc1_a8", "etc1_alpha"]
    choices = ["etc1_palette", *choices] if alpha_size and alpha_size > 0 else [*choices, "etc1_palette"]
    length = len(data) if data is not None else length
    for form in choices:
        try:
            if length is not None and payload_size(form, width, height, pitch, data) == length:
                return form
        except FormatError:
            continue
    return choices[0]


def _widened(v: np.ndarray, bits: int) -> np.ndarray:
    """To eight bits by repeating the high ones."""
    out, at = np.zeros_like(v), 8
    while at > 0:
        at -= bits
        out |= v << at if at >= 0 else v >> -at
    return out & 255


def _unpacked(words: np.ndarray, fields: dict) -> np.ndarray:
    out = np.full((*words.shape, 4), 255, np.uint8)
    for name, (shift, bits) in fields.items():
        v = _widened(words >> shift & ((1 << bits) - 1), bits)
        if name == "l":
            out[..., :3] = v[..., None]
        else:
            out[..., "rgba".index(name)] = v
    return out


def _packed(image: np.ndarray, fields: dict) -> np.ndarray:
    x = image.astype(np.int64)
    words = np.zeros(image.shape[:2], np.int64)
    for name, (shift, bits) in fields.items():
        v = x[..., :3].sum(-1) // 3 if name == "l" else x[..., "rgba".index(name)]
        words |= (v >> (8 - bits)) << shift
    return words


def _to_words(raw: np.ndarray, size: int) -> np.ndarray:
    parts = raw.reshape(*raw.shape[:-1], -1, size).astype(np.int64)
    return sum(parts[..., k] << 8 * k for k in range(size))


def _to_bytes(words: np.ndarray, size: int) -> np.ndarray:
    return np.stack([words >> 8 * k & 255 for k in range(size)], -1).astype(np.uint8).reshape(*words.shape[:-1], -1)


def _fields(form: str, order: str) -> tuple[int, dict]:
    size, fields = _WORDS[form]
    if form == "rgba8888" and order == "bgra":
        fields = fields | {"r": fields["b"], "b": fields["r"]}
    return size, fields


def _etc1_decode(data: bytes, width: int, height: int) -> np.ndarray:
    bw, bh = -(-width // 4), -(-height // 4)
    block = np.frombuffer(data, ">u8").astype(np.uint64)

    def bits(at: int, n: int) -> np.ndarray:
        return (block >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)

    apart, flip = bits(33, 1) == 0, bits(32, 1) == 1
    base = np.zeros((2, len(block), 3), np.int64)
    for c, at in enumerate((56, 48, 40)):
        five, step = bits(at + 3, 5), bits(at, 3)
        other = five + np.where(step > 3, step - 8, step)
        base[0, :, c] = np.where(apart, bits(at + 4, 4) * 17, five << 3 | five >> 2)
        base[1, :, c] = np.where(apart, bits(at, 4) * 17, other << 3 | (other & 28) >> 2)
    steps = np.stack([_STEPS[bits(37, 3)], _STEPS[bits(34, 3)]])
    out = np.full((bh, 4, bw, 4, 4), 255, np.uint8)
    n = np.arange(len(block))
    for x in range(4):
        for y in range(4):
            half = np.where(flip, y >= 2, x >= 2).astype(np.int64)
            add = steps[half, n, bits(4 * x + y, 1)] * np.where(bits(4 * x + y + 16, 1) == 1, -1, 1)
            out[:, y, :, x, :3] = np.clip(base[half, n] + add[:, None], 0, 255).reshape(bh, bw, 3)
    return out.reshape(4 * bh, 4 * bw, 4)[:height, :width]


def _etc1_encode(image: np.ndarray) -> bytes:
    """For both halvings of a block: each half's mean colour in four bits, the step table with the least error, the better halving. All blocks at once."""
    h, w = image.shape[:2]
    bh, bw = -(-h // 4), -(-w // 4)
    full = np.zeros((4 * bh, 4 * bw, 3), np.int64)
    full[:h, :w] = image[..., :3]
    blocks = full.reshape(bh, 4, bw, 4, 3).transpose(0, 2, 3, 1, 4).reshape(-1, 4, 4, 3)  # block, x, y
    best_error = np.full(len(blocks), np.iinfo(np.int64).max)
    best = np.zeros(len(blocks), np.uint64)
    for flip in (0, 1):
        word = np.full(len(blocks), flip << 32, np.uint64)
        error = np.zeros(len(blocks), np.int64)
        for half in (0, 1):
            part = (blocks[:, :, 2 * half : 2 * half + 2] if flip else blocks[:, 2 * half : 2 * half + 2]).reshape(-1, 8, 3)
            four = np.clip((part.mean(1) / 17).round().astype(np.int64), 0, 15)
            for c, at in enumerate((56, 48, 40)):
                word |= four[:, c].astype(np.uint64) << np.uint64(at + 4 * (1 - half))
            change = np.concatenate([_STEPS, -_STEPS], 1)  # code: sign above size
            shade = np.clip(four[:, None, None, :] * 17 + change[None, :, :, None], 0, 255)  # block, table, code, colour
            off = np.abs(part[:, None, :, None, :] - shade[:, :, None]).sum(-1)
            code, least = off.argmin(-1), off.min(-1).sum(-1)
            table = least.argmin(-1)
            error += least.min(-1)
            word |= table.astype(np.uint64) << np.uint64(34 if half else 37)
            code = code[np.arange(len(blocks)), table]
            for k in range(8):
                x, y = (k // 2, 2 * half + k % 2) if flip else (2 * half + k // 4, k % 4)
                word |= (code[:, k] & 1).astype(np.uint64) << np.uint64(4 * x + y)
                word |= (code[:, k] >> 1).astype(np.uint64) << np.uint64(4 * x + y + 16)
        better = error < best_error
        best, best_error = np.where(better, word, best), np.minimum(error, best_error)
    return best.astype(">u8").tobytes()


def _interleaved(bw: int, bh: int) -> np.ndarray:
    """Where the block (y, x) lies: the bits of y and x by turns, y's first, as far as the shorter side goes; then the longer side's other bits."""
    y, x = np.mgrid[:bh, :bw]
    short = min(bw, bh)
    depth = short.bit_length() - 1
    out = np.zeros((bh, bw), np.int64)
    for k in range(depth):
        out |= (y >> k & 1) << 2 * k | (x >> k & 1) << 2 * k + 1
    return out | (x if bw > bh else y) >> depth << 2 * depth


def _pvrtc_colours(words: np.ndarray, blue: int) -> np.ndarray:
    """Colours of 15 or 14 bits and an opacity bit: three colours of five bits, or alpha of three and colours of four; ``blue`` bits are cut from blue."""
    def field(shift: int, bits: int) -> np.ndarray:
        return _widened(words >> shift & ((1 << bits) - 1), bits)

    cut = 1 if blue else 0
    solid = np.stack([field(10 - cut, 5), field(5 - cut, 5), field(0, 5 - cut), np.full_like(words, 255)], -1)
    clear = np.stack([field(8 - cut, 4), field(4 - cut, 4), field(0, 4 - cut), field(12 - cut, 3)], -1)
    return np.where((words >> (15 - cut) & 1 == 1)[..., None], solid, clear)


def _spread(end: np.ndarray, py: int, px: int) -> np.ndarray:
    """Sixteen times the colour that a block's pixel has between the four nearest blocks' colours; edges meet their opposite."""
    far_y, far_x = (py + 2) % 4, (px + 2) % 4
    total = 0
    for dy, wy in ((0, 4 - far_y), (1, far_y)):
        for dx, wx in ((0, 4 - far_x), (1, far_x)):
            total = total + wy * wx * np.roll(end, ((py < 2) - dy, (px < 2) - dx), (0, 1))
    return total


def _pvrtc_word(colour: np.ndarray, solid: np.ndarray, cut: int) -> np.ndarray:
    """Colours (r, g, b, a) to the nearest word that ``_pvrtc_colours`` reads; ``solid`` ones without alpha."""
    def narrow(channel: int, bits: int) -> np.ndarray:
        return np.rint(colour[..., channel] * ((1 << bits) - 1) / 255).astype(np.int64)

    full = 1 << (15 - cut) | narrow(0, 5) << (10 - cut) | narrow(1, 5) << (5 - cut) | narrow(2, 5 - cut)
    clear = narrow(3, 3) << (12 - cut) | narrow(0, 4) << (8 - cut) | narrow(1, 4) << (4 - cut) | narrow(2, 4 - cut)
    return np.where(solid, full, clear)


def _pvrtc_encode(image: np.ndarray) -> bytes:
    """Each block's two colours are the means of its pixels on both sides of the middle of their widest channel; then every pixel takes the mixture that comes nearest to it."""
    height, width = image.shape[:2]
    bh, bw = height // 4, width // 4
    blocks = image.astype(np.float64).reshape(bh, 4, bw, 4, 4).transpose(0, 2, 1, 3, 4).reshape(bh, bw, 16, 4)
    low, high = blocks.min(2), blocks.max(2)
    widest = (high - low).argmax(-1)
    along = np.take_along_axis(blocks, widest[..., None, None], -1)[..., 0]
    middle = np.take_along_axis((low + high) / 2, widest[..., None], -1)
    upper = along > middle
    count = upper.sum(-1, keepdims=True)
    bright = np.where(count > 0, (blocks * upper[..., None]).sum(2) / np.maximum(count, 1), blocks.mean(2))
    dark = np.where(count < 16, (blocks * ~upper[..., None]).sum(2) / np.maximum(16 - count, 1), blocks.mean(2))
    solid = (blocks[..., 3] == 255).all(-1)
    words = [_pvrtc_word(dark, solid, 1), _pvrtc_word(bright, solid, 0)]
    ends = [_pvrtc_colours(words[0], 1), _pvrtc_colours(words[1], 0)]
    turns = np.zeros((bh, bw), np.int64)
    pixels = image.astype(np.int64).reshape(bh, 4, bw, 4, 4)
    for py in range(4):
        for px in range(4):
            a, b = (_spread(end, py, px) for end in ends)
            error = np.stack([(((a * n + b * (8 - n) >> 7) - pixels[:, py, :, px]) ** 2).sum(-1) for n in (8, 5, 3, 0)])
            turns |= error.argmin(0) << 2 * (4 * py + px)
    word = turns.astype(np.uint64) | words[0].astype(np.uint64) << np.uint64(33) | words[1].astype(np.uint64) << np.uint64(48)
    out = np.zeros(bh * bw, "<u8")
    out[_interleaved(bw, bh).reshape(-1)] = word.reshape(-1)
    return out.tobytes()


def _pvrtc_decode(data: bytes, width: int, height: int) -> np.ndarray:
    """Two low-resolution images, spread bilinearly and mixed by two bits for each pixel; edges meet their opposite."""
    bw, bh = width // 4, height // 4
    word = np.frombuffer(data, "<u8")[_interleaved(bw, bh)]
    turns = (word & np.uint64(0xFFFFFFFF)).astype(np.int64)
    punch = (word >> np.uint64(32) & np.uint64(1)).astype(bool)
    ends = _pvrtc_colours((word >> np.uint64(33) & np.uint64(0x7FFF)).astype(np.int64), 1), _pvrtc_colours((word >> np.uint64(48)).astype(np.int64), 0)
    out = np.zeros((bh, 4, bw, 4, 4), np.uint8)
    for py in range(4):
        for px in range(4):
            mixed = [_spread(end, py, px) for end in ends]
            code = turns >> 2 * (4 * py + px) & 3
            a = np.where(punch, np.array([8, 4, 4, 0])[code], np.array([8, 5, 3, 0])[code])[..., None]
            value = mixed[0] * a + mixed[1] * (8 - a) >> 7
            value[..., 3] = np.where(punch & (code == 2), 0, value[..., 3])
            out[:, py, :, px] = value
    return out.reshape(height, width, 4)


def _palette_decode(data: bytes, pixels: int) -> np.ndarray:
    count = data[0]
    values = np.array([0, 255]) if not count else np.frombuffer(data[1 : 1 + count], np.uint8).astype(np.int64) * 17 & 255
    depth = (count - 1).bit_length() if count else 1
    if not depth:
        return np.full(pixels, values[0], np.uint8)
    bits = np.unpackbits(np.frombuffer(data[1 + count :], np.uint8))[: pixels * depth].reshape(pixels, depth)
    index = (bits << np.arange(depth - 1, -1, -1)).sum(1)
    return np.where(index < len(values), values[np.minimum(index, len(values) - 1)], values[0]).astype(np.uint8)


def decode(data: bytes, form: str, width: int, height: int, pitch: int | None = None, order: str = "rgba") -> np.ndarray:
    """An image as (height, width, 4). ASTC is not decoded."""
    want = payload_size(form, width, height, pitch, data)
    if len(data) != want:
        raise FormatError(f"{form}: {len(data)} bytes, {want} expected")
    raw = np.frombuffer(data, np.uint8)
    if form.endswith("_tiled"):
        size, fields = _fields(form.removesuffix("_tiled"), order)
        th, tw = -(-height // TILE), -(-width // TILE)
        words = _to_words(raw, size).reshape(th, tw, TILE, TILE).transpose(0, 2, 1, 3).reshape(th * TILE, tw * TILE)
        return _unpacked(words[:height, :width], fields)
    if form in _WORDS:
        size, fields = _fields(form, order)
        return _unpacked(_to_words(raw.reshape(height, -1)[:, : width * size], size), fields)
    if form.startswith("pvrtc4"):
        image = _pvrtc_decode(data[: _pvrtc_size(width, height)], width, height)
        if form == "pvrtc4_a8":
            image[..., 3] = raw[_pvrtc_size(width, height) :].reshape(height, width)
        return image
    if not form.startswith("etc1"):
        raise FormatError(f"{form} is not decoded")
    colour = _etc1_size(width, height)
    image = _etc1_decode(data[:colour], width, height).copy()
    if form == "etc1_a8":
        image[..., 3] = raw[colour:].reshape(height, width)
    elif form == "etc1_alpha":
        image[..., 3] = _etc1_decode(data[colour:], width, height)[..., 1]
    elif form == "etc1_palette":
        image[..., 3] = _palette_decode(data[colour:], width * height).reshape(height, width)
    return image


def encode(image: np.ndarray, form: str, pitch: int | None = None, order: str = "rgba") -> bytes:
    """The payload of an image. Palette indices are written from the high bit on, as they are read."""
    height, width = image.shape[:2]
    size_ = payload_size(form, width, height, pitch)
    if form.endswith("_tiled"):
        size, fields = _fields(form.removesuffix("_tiled"), order)
        th, tw = -(-height // TILE), -(-width // TILE)
        words = np.zeros((th * TILE, tw * TILE), np.int64)
        words[:height, :width] = _packed(image, fields)
        return _to_bytes(words.reshape(th, TILE, tw, TILE).transpose(0, 2, 1, 3).reshape(-1), size).tobytes()
    if form in _WORDS:
        size, fields = _fields(form, order)
        rows = _to_bytes(_packed(image, fields), size)
        out = np.zeros((height, size_ // height), np.uint8)
        out[:, : rows.shape[1]] = rows
        return out.tobytes()
    if form == "pvrtc4":
        return _pvrtc_encode(image)
    if form == "pvrtc4_a8":
        return _pvrtc_encode(np.concatenate([image[..., :3], np.full_like(image[..., 3:], 255)], -1)) + image[..., 3].tobytes()
    if not form.startswith("etc1"):
        raise FormatError(f"{form} is not encoded")
    out = _etc1_encode(image)
    alpha = image[..., 3]
    if form == "etc1_a8":
        out += alpha.tobytes()
    elif form == "etc1_alpha":
        out += _etc1_encode(np.repeat(alpha[..., None], 4, -1))
    elif form == "etc1_palette":
        four = (alpha >> 4).reshape(-1)
        four = np.append(four, np.uint8(0)) if len(four) % 2 else four
        out += bytes([16, *range(16)]) + (four[::2] << 4 | four[1::2]).astype(np.uint8).tobytes()
    return out


def to_png(image: np.ndarray) -> bytes:
    """A PNG file, rows filtered by difference to the one above."""
    height, width = image.shape[:2]
    rows = np.zeros((height, 1 + 4 * width), np.uint8)
    flat = np.ascontiguousarray(image).reshape(height, -1)
    rows[:, 0] = 2
    rows[0, 1:] = flat[0]
    rows[1:, 1:] = flat[1:] - flat[:-1]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """An 8-bit RGB or RGBA PNG, any filters, not interlaced."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        raise FormatError("not a PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        head = struct.unpack(">2I5B", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    if not head or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise FormatError("only 8-bit RGB and RGBA without interlace are read")
    width, height, channels = head[0], head[1], 3 if head[3] == 2 else 4
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, -1)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above & 255
        elif kind in (1, 3, 4):
            for x in range(len(line)):
                a = line[x - channels] if x >= channels else 0
                b, c = above[x], above[x - channels] if x >= channels else 0
                if kind == 4:
                    p = a + b - c
                    guess = min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
                else:
                    guess = a if kind == 1 else (a + b) // 2
                line[x] = line[x] + guess & 255
        out[y], above = line, line
    image = out.reshape(height, width, channels)
    return image if channels == 4 else np.concatenate([image, np.full((height, width, 1), 255, np.uint8)], -1)
