"""Grey pixels of PNG and PGM images, and their difference hash."""

from __future__ import annotations

import zlib

import numpy as np

# The signature of a PNG, samples a pixel by colour type, the passes of interlacing (first column, first row, steps), luma weights of 2^16.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
LUMA = (19595, 38470, 7471)


def _unfiltered(data: bytes, rows: int, row_bytes: int, step: int) -> np.ndarray:
    """Scan lines with their filter taken back: none, left, up, mean of both, or the nearest of left, up and the corner to left + up - corner."""
    out = np.zeros((rows + 1, row_bytes + step), np.uint8)  # a line above and a pixel to the left, of zeros
    for y in range(1, rows + 1):
        at = (y - 1) * (row_bytes + 1)
        kind, line = data[at], np.frombuffer(data, np.uint8, row_bytes, at + 1)
        up, own = out[y - 1, step:], out[y, step:]
        if kind == 0:
            own[:] = line
        elif kind == 1:
            for k in range(step):
                own[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            own[:] = line + up
        elif kind in (3, 4):
            for x in range(0, row_bytes, step):
                left, above = out[y, x : x + step].astype(int), out[y - 1, x + step : x + 2 * step].astype(int)
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    corner = out[y - 1, x : x + step].astype(int)
                    far = [abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)]
                    guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
                out[y, x + step : x + 2 * step] = line[x : x + step] + guess
        else:
            raise ValueError("an unknown filter")
    return out[1:, step:]


def _samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """Samples of a scan line's bytes, rows x width x channels."""
    if depth == 8:
        flat = lines.astype(np.int64)
    elif depth == 16:
        flat = lines[:, ::2].astype(np.int64) * 256 + lines[:, 1::2]
    else:
        bits = np.unpackbits(lines, axis=1)[:, : width * channels * depth].reshape(len(lines), -1, depth)
        flat = bits.astype(np.int64) @ (1 << np.arange(depth)[::-1])
    return flat[:, : width * channels].reshape(len(lines), width, channels)


def decode_png(data: bytes) -> np.ndarray:
    """Grey values 0 to 255 (height x width) of a PNG of any colour type, depth and interlacing; transparency is left out."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG")
    at, packed, palette, head = len(SIGNATURE), [], None, b""
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        body, at = data[at + 8 : at + 8 + size], at + 12 + size
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    width, height, depth, colour, interlaced = int.from_bytes(head[:4]), int.from_bytes(head[4:8]), head[8], head[9], head[12]
    channels, raw, at = CHANNELS[colour], zlib.decompress(b"".join(packed)), 0
    out = np.zeros((height, width, channels), np.int64)
    for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = len(range(x0, width, dx)), len(range(y0, height, dy))
        if w and h:
            row_bytes = -(-w * channels * depth // 8)
            lines = _unfiltered(raw[at : at + h * (row_bytes + 1)], h, row_bytes, max(1, channels * depth // 8))
            out[y0::dy, x0::dx] = _samples(lines, w, depth, channels)
            at += h * (row_bytes + 1)
    if colour == 3:
        out = palette[out[:, :, 0]]
    else:
        out = out >> 8 if depth == 16 else out * 255 // ((1 << depth) - 1)
    if out.shape[2] < 3:
        return out[:, :, 0].astype(np.uint8)
    return ((out[:, :, :3] @ np.array(LUMA) + (1 << 15)) >> 16).astype(np.uint8)


def decode_pgm(data: bytes) -> np.ndarray:
    head, size, top, pixels = data.split(b"\n", 3)
    if head != b"P5" or top != b"255":
        raise ValueError("a binary grey map of 8 bits is wanted")
    w, h = map(int, size.split())
    return np.frombuffer(pixels, np.uint8, w * h).reshape(h, w)


def grey(data: bytes) -> np.ndarray:
    return decode_png(data) if data.startswith(SIGNATURE) else decode_pgm(data)


def _cells(a: np.ndarray, n: int) -> np.ndarray:
    """Columns shrunk to ``n`` cells of equal width: n times the sum of each, parts of columns by their share."""
    sums = np.concatenate([np.zeros((len(a), 1), np.int64), np.cumsum(a, 1, dtype=np.int64)], 1)
    whole, part = np.divmod(np.arange(n + 1) * a.shape[1], n)
    edge = np.concatenate([a, np.zeros((len(a), 1), np.int64)], 1)[:, whole]
    return np.diff(n * sums[:, whole] + part * edge, axis=1)


def difference_hash(a: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 area means (exact, as whole numbers) is below its right neighbour."""
    means = _cells(_cells(a.astype(np.int64), 9).T, 8).T
    bits = (means[:, 1:] > means[:, :-1]).ravel()
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])
