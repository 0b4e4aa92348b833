"""Baseline JPEG files from pixels, in numpy: the format of crops that are stored or sent.

Blocks are transformed and quantised together; a list of all symbols, in their order, gives the code lengths that suit
the image, and then its bits. Nothing is decided pixel by pixel in Python.
"""

from __future__ import annotations

import struct

import numpy as np

# The quality of crops; the standard's example tables for luminance and, in their first corner, chrominance.
QUALITY = 92
LUMINANCE = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99],
])
CHROMINANCE = np.full((8, 8), 99)
CHROMINANCE[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]

#: Diagonals from the first corner on, up and down by turns.
ZIGZAG = np.array([8 * i + j for i, j in sorted(np.ndindex(8, 8), key=lambda p: (sum(p), p[sum(p) % 2 == 0]))])
_COSINES = np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16) / 2
_COSINES[0] /= np.sqrt(2)
_BITS = np.array([k.bit_length() for k in range(4096)])
#: Blocks of a unit of 16 x 16 pixels: four of luminance, two of chrominance. Symbols whose bits are made at once.
UNIT, CHUNK = 6, 1 << 18
LONGEST = 16


def quantisers(quality: int) -> tuple[np.ndarray, np.ndarray]:
    scale = 200 - 2 * quality if quality >= 50 else 5000 // quality
    return tuple(np.clip((t * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE))


def _blocks(plane: np.ndarray) -> np.ndarray:
    """(rows, columns, 8, 8) blocks of a plane whose sides are multiples of 8."""
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)


def coefficients(bgr: np.ndarray, quality: int) -> np.ndarray:
    """Quantised coefficients (blocks, 64) in zigzag order, unit by unit; chrominance has half the pixels a side."""
    h, w = bgr.shape[:2]
    b, g, r = np.pad(bgr, ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge").astype(np.float32).transpose(2, 0, 1)
    luma = 0.299 * r + 0.587 * g + 0.114 * b
    half = lambda p: p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean(axis=(1, 3))
    blue, red = (_blocks(half(x - luma) / np.float32(k)) for x, k in ((b, 1.772), (r, 1.402)))
    rows, columns = blue.shape[:2]
    four = _blocks(luma - 128).reshape(rows, 2, columns, 2, 8, 8).swapaxes(1, 2).reshape(rows * columns, 4, 8, 8)
    units = np.concatenate([four, blue.reshape(-1, 1, 8, 8), red.reshape(-1, 1, 8, 8)], axis=1)
    cosines = _COSINES.astype(np.float32)
    steps = np.stack([t for t, n in zip(quantisers(quality), (4, 2)) for _ in range(n)])
    found = np.rint(cosines @ units @ cosines.T / steps.astype(np.float32)).clip(-1023, 1023).astype(np.int32)
    return found.reshape(-1, 64)[:, ZIGZAG]


def symbols(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol with 256 times its table, further bits, how many) of all blocks in their order. Tables: first coefficients and others of luminance, then of chrominance."""
    kind = np.arange(len(found)) % UNIT
    table = np.where(kind < 4, 0, 2)
    first = found[:, 0]
    steps = np.empty_like(first)
    for which in (kind < 4, kind == 4, kind == 5):
        steps[which] = np.diff(first[which], prepend=0)
    block, place = np.nonzero(found[:, 1:])
    place += 1
    value = found[block, place]
    gap = place - np.where(np.r_[True, block[1:] != block[:-1]], 0, np.r_[0, place[:-1]])[: len(place)] - 1
    wide = gap >> 4  # a symbol for each sixteen zeros
    of = np.repeat(np.arange(len(place)), wide)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(wide) - wide, wide)
    last = np.zeros(len(found), np.int64)
    last[block] = place
    open_ = np.flatnonzero(last < 63)
    size, step_size = _BITS[np.abs(value)], _BITS[np.abs(steps)]
    more = lambda v, n: np.where(v < 0, v + (1 << n) - 1, v)
    at = np.concatenate([np.arange(len(found)) << 8, block << 8 | place << 2 | 3, block[of] << 8 | place[of] << 2 | turn, open_ << 8 | 255])
    symbol = np.concatenate([table << 8 | step_size, table[block] + 1 << 8 | (gap & 15) << 4 | size, table[block[of]] + 1 << 8 | 0xF0, table[open_] + 1 << 8])
    none = np.zeros(len(of) + len(open_), np.int64)
    extra = np.concatenate([more(steps, step_size), more(value, size), none])
    bits = np.concatenate([step_size, size, none])
    order = np.argsort(at)
    return symbol[order], extra[order], bits[order]


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Lengths of the best prefix code with none over ``longest``, by merging packages."""
    leaves = sorted((n, (s,)) for s, n in counts.items())
    packages: list = []
    for _ in range(longest):
        merged = sorted(leaves + packages, key=lambda x: x[0])
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(merged[::2], merged[1::2])]
    lengths = dict.fromkeys(counts, 0)
    for _, members in packages[: len(leaves) - 1]:
        for s in members:
            lengths[s] += 1
    return lengths


def codes(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(length, code) of each symbol, in order of their codes. A symbol that never comes takes the code of ones alone, which the format forbids."""
    lengths = code_lengths(counts | {256: 0})
    out, code, was = {}, 0, 0
    for length, s in sorted((n, s) for s, n in lengths.items()):
        code <<= length - was
        out[s] = (length, code)
        code, was = code + 1, length
    del out[256]
    return out


def _packed(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """The lowest ``lengths`` bits of each value, one after the other; the last byte is filled with ones."""
    out, held = [], np.zeros(0, np.uint8)
    for at in range(0, len(values), CHUNK):
        v, n = values[at : at + CHUNK], lengths[at : at + CHUNK]
        down = np.repeat(np.cumsum(n), n) - np.arange(n.sum()) - 1
        held = np.r_[held, (np.repeat(v, n) >> down & 1).astype(np.uint8)]
        whole = len(held) // 8 * 8
        out.append(np.packbits(held[:whole]).tobytes())
        held = held[whole:]
    if len(held):
        out.append(np.packbits(np.r_[held, np.ones(-len(held) % 8, np.uint8)]).tobytes())
    return b"".join(out)


def encode(bgr: np.ndarray, quality: int = QUALITY) -> bytes:
    """A JPEG file of (H, W, 3) bytes in blue, green, red."""
    h, w = bgr.shape[:2]
    if not (0 < h < 65536 and 0 < w < 65536):
        raise ValueError(f"an image of {w} x {h} pixels has no JPEG file")
    symbol, extra, bits = symbols(coefficients(bgr, quality))
    part = lambda marker, data: struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data
    head = [b"\xff\xd8", part(0xE0, b"JFIF\0" + struct.pack(">BBBHHBB", 1, 1, 0, 1, 1, 0, 0))]
    head += [part(0xDB, bytes([i, *t.ravel()[ZIGZAG].tolist()])) for i, t in enumerate(quantisers(quality))]
    head.append(part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])))
    lengths, code = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    for k, seen in enumerate(np.bincount(symbol, minlength=1024).reshape(4, 256)):
        own = codes({s: int(seen[s]) for s in np.flatnonzero(seen).tolist()})
        for s, (length, value) in own.items():
            lengths[k << 8 | s], code[k << 8 | s] = length, value
        each = np.bincount([n for n, _ in own.values()], minlength=LONGEST + 1)[1:]
        head.append(part(0xC4, bytes([(k & 1) << 4 | k >> 1, *each.tolist(), *own])))
    head.append(part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])))
    data = _packed(code[symbol] << bits | extra, lengths[symbol] + bits)
    return b"".join(head) + data.replace(b"\xff", b"\xff\0") + b"\xff\xd9"
