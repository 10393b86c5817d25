"""Pixels of PNG, BMP, GIF, TIFF and baseline JPEG images with numpy: reading, shrinking, and writing PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np


class CannotDecode(ValueError):
    pass


_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes, rows: int | None = None) -> np.ndarray:
    """Pixels as height x width x 4 bytes; of JPEG images only the first ``rows`` rows, and maybe a few more."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:4] == b"GIF8":
        return _gif(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(data)
    if data[:3] == b"\xff\xd8\xff":
        return _jpeg(data, rows)
    raise CannotDecode("crop is supported for PNG, BMP, GIF, TIFF and JPEG only")


def _solid(colors: np.ndarray) -> np.ndarray:
    return np.concatenate([colors, np.full((*colors.shape[:-1], 1), 255, np.uint8)], -1)


def _looked_up(palette: np.ndarray, index: np.ndarray) -> np.ndarray:
    if index.max(initial=0) >= len(palette):
        raise CannotDecode("bad palette")
    return palette[index]


def _unpacked(lines: np.ndarray, depth: int, count: int) -> np.ndarray:
    """Samples of fewer than eight bits, ``count`` of every line."""
    bits = np.unpackbits(lines, axis=1)[:, : count * depth].reshape(len(lines), count, depth)
    return (bits * (1 << np.arange(depth)[::-1])).sum(2).astype(np.uint8)


def _png(data: bytes) -> np.ndarray:
    at, packed, palette, clear, header = 8, [], None, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise CannotDecode("unexpected end of file")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if header is None:
        raise CannotDecode("no header")
    width, height, depth, color, _, _, interlace = header
    if color not in _CHANNELS or depth not in (1, 2, 4, 8, 16):
        raise CannotDecode("unknown kind of PNG")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise CannotDecode(str(e)) from e
    if interlace:
        x, at = np.zeros((height, width, _CHANNELS[color]), np.uint8), 0
        # Adam7: in each pass every so many columns and rows from a first one on.
        for x0, y0, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
            if x0 < width and y0 < height:
                x[y0::dy, x0::dx], at = _png_samples(raw, at, -(-(width - x0) // dx), -(-(height - y0) // dy), depth, color)
    else:
        x, _ = _png_samples(raw, 0, width, height, depth, color)
    if color == 3:
        if palette is None:
            raise CannotDecode("bad palette")
        colors = _solid(palette)
        colors[: len(clear), 3] = np.frombuffer(clear, np.uint8)[: len(colors)]
        return _looked_up(colors, x[:, :, 0])
    if color in (0, 4):
        gray = np.repeat(x[:, :, :1], 3, 2)
        return np.concatenate([gray, x[:, :, 1:]], 2) if color == 4 else _solid(gray)
    return _solid(x) if color == 2 else x


def _png_samples(raw: np.ndarray, at: int, width: int, height: int, depth: int, color: int) -> tuple[np.ndarray, int]:
    """The samples of one pass as height x width x channels in eight bits, and where the next pass begins."""
    bits = depth * _CHANNELS[color]
    stride, step = (width * bits + 7) // 8, max(1, bits // 8)
    end = at + height * (stride + 1)
    if len(raw) < end:
        raise CannotDecode("unexpected end of pixels")
    rows = raw[at:end].reshape(height, stride + 1)
    lines = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        above = lines[y] = _unfilter(int(rows[y, 0]), rows[y, 1:], above, step)
    if depth == 16:
        lines = lines.reshape(height, -1, 2)[:, :, 0]
    elif depth < 8:
        lines = _unpacked(lines, depth, width)
        if color == 0:
            lines = (lines * (255 // ((1 << depth) - 1))).astype(np.uint8)
    return lines.reshape(height, width, _CHANNELS[color]), end


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(np.pad(line, (0, -len(line) % step)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
    if kind not in (3, 4):
        raise CannotDecode("unknown filter")
    out, up = bytearray(line.tobytes()), above.tobytes()
    for i in range(len(out)):
        a, b = (out[i - step] if i >= step else 0), up[i]
        if kind == 3:
            out[i] = (out[i] + (a + b) // 2) & 255
        else:
            c = up[i - step] if i >= step else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out[i] = (out[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return np.frombuffer(bytes(out), np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    try:
        start, size = struct.unpack_from("<II", data, 10)
        width, height, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    except struct.error as e:
        raise CannotDecode("unexpected end of file") from e
    if depth not in (1, 4, 8, 24, 32) or packing not in (0, 3) or packing and depth != 32 or size < 40 or width <= 0:
        raise CannotDecode("BMP of an old kind or with packing")
    stride = (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data[start : start + stride * abs(height)], np.uint8)
    if len(raw) < stride * abs(height):
        raise CannotDecode("unexpected end of pixels")
    lines = raw.reshape(abs(height), stride)
    lines = lines[::-1] if height > 0 else lines
    if depth <= 8:
        count = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.frombuffer(data[14 + size : 14 + size + 4 * count], np.uint8)
        index = lines[:, :width] if depth == 8 else _unpacked(lines, depth, width)
        return _solid(_looked_up(palette[: len(palette) // 4 * 4].reshape(-1, 4)[:, 2::-1], index))
    return _solid(lines[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1])


def _lzw(packed: bytes, least: int, early: int, big: bool, size: int) -> bytes:
    """At most ``size`` bytes of LZW data with codes from ``least`` + 1 to 12 bits, from either end of a byte."""
    clear, out, bits, n = 1 << least, bytearray(), 0, 0
    table: list[bytes] = []
    width, last = least + 1, b""
    for byte in packed:
        bits, n = (bits << 8 | byte, n + 8) if big else (bits | byte << n, n + 8)
        while n >= width:
            n -= width
            code, bits = (bits >> n, bits & (1 << n) - 1) if big else (bits & (1 << width) - 1, bits >> width)
            if code == clear:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
                width, last = least + 1, b""
                continue
            if code == clear + 1 or len(out) >= size:
                return bytes(out[:size])
            if not table or code > len(table) or code == len(table) and not last:
                raise CannotDecode("broken LZW data")
            now = table[code] if code < len(table) else last + last[:1]
            if last and len(table) < 4096:
                table.append(last + now[:1])
            out += now
            last = now
            if len(table) + early >= 1 << width and width < 12:
                width += 1
    return bytes(out[:size])


def _gif(data: bytes) -> np.ndarray:
    """The first frame on a clear canvas."""
    try:
        width, height, flags = struct.unpack_from("<HHB", data, 6)
        at, palette, clear = 13, b"", None
        if flags & 0x80:
            palette = data[at : at + (6 << (flags & 7))]
            at += 6 << (flags & 7)
        while data[at] == 0x21:
            if data[at + 1] == 0xF9:
                clear = data[at + 6] if data[at + 3] & 1 else None
            at += 2
            while data[at]:
                at += 1 + data[at]
            at += 1
        if data[at] != 0x2C:
            raise CannotDecode("no frame")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        if flags & 0x80:
            palette = data[at : at + (6 << (flags & 7))]
            at += 6 << (flags & 7)
        least, at, packed = data[at], at + 1, []
        while data[at]:
            packed.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
    except (struct.error, IndexError) as e:
        raise CannotDecode("unexpected end of file") from e
    index = np.frombuffer(_lzw(b"".join(packed), least, 0, False, w * h), np.uint8)
    if len(index) < w * h:
        raise CannotDecode("unexpected end of pixels")
    index = index.reshape(h, w)
    if flags & 0x40:  # rows in four passes
        order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
        index = index[np.argsort(order)]
    colors = _solid(np.frombuffer(palette, np.uint8).reshape(-1, 3))
    frame = _looked_up(colors, index).copy()
    if clear is not None:
        frame[index == clear] = 0
    out = np.zeros((height, width, 4), np.uint8)
    out[top : top + h, left : left + w] = frame[: max(0, height - top), : max(0, width - left)]
    return out


def _tiff(data: bytes) -> np.ndarray:
    """The first image, in strips, of eight bits a sample: plain, LZW, deflate or PackBits."""
    order = "<" if data[:2] == b"II" else ">"
    tags: dict[int, tuple[int, ...]] = {}
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            code = {1: "B", 3: "H", 4: "I"}.get(kind)
            if code:
                place = at + 10 + 12 * i
                if struct.calcsize("=" + code) * count > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
    except struct.error as e:
        raise CannotDecode("unexpected end of file") from e
    one = lambda tag, value: tags.get(tag, (value,))[0]
    width, height, packing, kind, samples = one(256, 0), one(257, 0), one(259, 1), one(262, 1), one(277, 1)
    if set(tags.get(258, (1,))) != {8} or kind not in (0, 1, 2, 3) or one(284, 1) != 1 or 273 not in tags or one(317, 1) not in (1, 2):
        raise CannotDecode("TIFF in tiles or planes, or not of eight bits a sample")
    per = min(one(278, height), height)
    stride, lines = width * samples, []
    for k, (start, size) in enumerate(zip(tags[273], tags.get(279, (len(data),)))):
        want = stride * min(per, height - k * per)
        lines.append(_strip(data[start : start + size], packing, want))
    raw = np.frombuffer(b"".join(lines), np.uint8)
    if len(raw) < stride * height or not height:
        raise CannotDecode("unexpected end of pixels")
    x = raw[: stride * height].reshape(height, width, samples)
    if one(317, 1) == 2:
        x = np.cumsum(x, axis=1, dtype=np.uint8)
    if kind == 3:
        colors = np.array(tags.get(320, ()), np.int64).reshape(3, -1).T >> 8
        return _solid(_looked_up(colors.astype(np.uint8), x[:, :, 0]))
    x = 255 - x[:, :, :1] if kind == 0 else x
    return _solid(np.repeat(x[:, :, :1], 3, 2)) if kind < 2 else x[:, :, :4] if samples > 3 else _solid(x)


def _strip(packed: bytes, packing: int, size: int) -> bytes:
    if packing == 1:
        out = packed[:size]
    elif packing == 5:
        out = _lzw(packed, 8, 1, True, size)
    elif packing in (8, 32946):
        try:
            out = zlib.decompressobj().decompress(packed, size)
        except zlib.error as e:
            raise CannotDecode(str(e)) from e
    elif packing == 32773:
        parts, at = [], 0
        while at < len(packed):
            n = packed[at]
            parts.append(packed[at + 1 : at + 2 + n] if n < 128 else packed[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 2 + n if n < 128 else 2 if n > 128 else 1
        out = b"".join(parts)[:size]
    else:
        raise CannotDecode("unknown packing of TIFF")
    if len(out) < size:
        raise CannotDecode("unexpected end of pixels")
    return out


#: Places of coefficients in the order of JPEG files: along the diagonals of an 8 x 8 block, to and fro.
_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_COSINES = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


def _jpeg(data: bytes, rows: int | None) -> np.ndarray:
    """A baseline JPEG with one scan, gray or in three colours; colours of fewer samples are repeated."""
    at, tables, codes, frame, every, adobe = 2, {}, {}, None, 0, 1
    try:
        while True:
            kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if data[at] != 0xFF or kind in (0xC2, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise CannotDecode("JPEG that is progressive, or of another kind than baseline")
            at += 2 + size
            if kind == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    tables[body[i] & 15] = np.array(struct.unpack_from(">64" + "BH"[wide], body, i + 1))
                    i += 65 + 64 * wide
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    counts = body[i + 1 : i + 17]
                    codes[body[i]] = _huffman(counts, body[i + 17 : i + 17 + sum(counts)])
                    i += 17 + sum(counts)
            elif kind in (0xC0, 0xC1):
                depth, height, width, n = struct.unpack_from(">BHHB", body)
                frame = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif kind == 0xDD:
                (every,) = struct.unpack(">H", body)
            elif kind == 0xEE and body[:5] == b"Adobe":
                adobe = body[11]
            elif kind == 0xDA:
                break
        if frame is None or depth != 8 or len(frame) not in (1, 3) or body[0] != len(frame):
            raise CannotDecode("JPEG of several scans or of other colours")
        used = {body[1 + 2 * k]: (codes[body[2 + 2 * k] >> 4], codes[16 | body[2 + 2 * k] & 15]) for k in range(body[0])}
        parts = [(h, v, tables[t], *used[c]) for c, h, v, t in frame]
    except (struct.error, IndexError, KeyError) as e:
        raise CannotDecode("broken JPEG header") from e
    if len(parts) == 1:
        parts = [(1, 1, *parts[0][2:])]
    most_h, most_v = max(p[0] for p in parts), max(p[1] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    down = min(down, -(-rows // (8 * most_v))) if rows is not None else down
    blocks = [np.zeros((down * v, across * h, 64), np.int32) for h, v, *_ in parts]
    read = _Bits(data, at)
    before = [0] * len(parts)
    for m in range(across * down):
        if every and m and m % every == 0:
            read.restart()
            before = [0] * len(parts)
        y, x = divmod(m, across)
        for k, (h, v, _, dc, ac) in enumerate(parts):
            for j in range(v):
                for i in range(h):
                    out = blocks[k][y * v + j, x * h + i]
                    before[k] += read.value(read.symbol(dc))
                    out[0], place = before[k], 1
                    while place < 64:
                        symbol = read.symbol(ac)
                        if symbol == 0:
                            break
                        place += symbol >> 4
                        if symbol & 15 and place < 64:
                            out[_ZIGZAG[place]] = read.value(symbol & 15)
                        place += 1
    planes = []
    for (h, v, table, *_), b in zip(parts, blocks):
        scale = np.zeros(64)
        scale[_ZIGZAG] = table
        spread = _COSINES.T @ (b * scale).reshape(*b.shape[:2], 8, 8) @ _COSINES
        plane = spread.transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, -1) + 128
        planes.append(np.repeat(np.repeat(plane, most_v // v, 0), most_h // h, 1)[:height, :width])
    if len(planes) == 3 and adobe:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    planes = planes if len(planes) == 3 else planes * 3
    return _solid(np.clip(np.floor(np.stack(planes, 2) + 0.5), 0, 255).astype(np.uint8))


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """The symbol of each (length, code)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """Bits of a JPEG's entropy-coded data, from the highest of every byte on; noughts after its end."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at, self.bits, self.n = data, at, 0, 0

    def take(self) -> int:
        if not self.n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            if byte == 0xFF:
                if self.data[self.at + 1 : self.at + 2] == b"\0":
                    self.at += 2
                else:
                    byte = 0  # a marker, which stays
            else:
                self.at += 1
            self.bits, self.n = byte, 8
        self.n -= 1
        return self.bits >> self.n & 1

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take()
            if (length, code) in codes:
                return codes[length, code]
        raise CannotDecode("broken JPEG data")

    def value(self, size: int) -> int:
        code = 0
        for _ in range(size):
            code = code << 1 | self.take()
        return code if not size or code >> size - 1 else code - (1 << size) + 1

    def restart(self) -> None:
        self.n = 0
        while self.at + 1 < len(self.data) and not (self.data[self.at] == 0xFF and 0xD0 <= self.data[self.at + 1] <= 0xD7):
            self.at += 1
        self.at += 2


def shrink(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resampled with a triangle filter as wide as the shrinking."""
    return np.clip(np.floor(_weights(pixels.shape[0], height) @ np.einsum("ij,hjc->hic", _weights(pixels.shape[1], width), pixels.astype(float)).reshape(pixels.shape[0], -1) + 0.5), 0, 255).reshape(height, width, 4).astype(np.uint8)


def _weights(n: int, m: int) -> np.ndarray:
    scale = max(n / m, 1.0)
    center = (np.arange(m) + 0.5) * n / m - 0.5
    w = np.clip(1 - np.abs(np.arange(n)[None, :] - center[:, None]) / scale, 0, None)
    return w / w.sum(1, keepdims=True)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG with eight bits per channel, no filters, and always the same bytes for the same pixels."""
    height, width, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
