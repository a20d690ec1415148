"""Baseline JPEG files of 8-bit planes (4:2:0), by numpy transforms and the standard's tables."""

from __future__ import annotations

import struct

import numpy as np

from wavelattice.sources.bitio import BitSink, Huffman

# Fixed values of the standard: quantisation at quality 50 in rows; code counts by length and symbols.
LUMA_QUANT = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_QUANT = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
LUMA_DC = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
CHROMA_DC = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
LUMA_AC = (
    bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
    bytes.fromhex(
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 "
        "24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 "
        "4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 "
        "8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 "
        "c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 "
        "f9 fa "
    ),
)
CHROMA_AC = (
    bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
    bytes.fromhex(
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 "
        "15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 "
        "49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 "
        "88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 "
        "c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 "
        "f9 fa "
    ),
)

# Diagonals, odd ones downwards.
ZIGZAG = np.array([8 * r + c for s in range(15) for r, c in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), key=lambda p, s=s: p[0] if s % 2 else p[1])])
_BASIS = np.array([[(np.sqrt(1 / 8) if k == 0 else 0.5) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


def quantisers(quality: int) -> list[np.ndarray]:
    """Luma and chroma tables in rows at a quality from 1 to 100."""
    if not 1 <= quality <= 100:
        raise ValueError("quality must lie between 1 and 100")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA_QUANT, CHROMA_QUANT)]


def _blocks(plane: np.ndarray, quant: np.ndarray, step: int) -> np.ndarray:
    """Quantised coefficients (block rows, block columns, 64 in zigzag order) of a plane padded to whole cells of ``step`` pixels."""
    h, w = plane.shape
    x = np.pad(plane.astype(np.float64) - 128, ((0, -h % step), (0, -w % step)), mode="edge")
    x = x.reshape(x.shape[0] // 8, 8, x.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    c = np.einsum("ui,abij,vj->abuv", _BASIS, x, _BASIS).reshape(*x.shape[:2], 64)
    return np.rint(c / quant).astype(np.int64)[..., ZIGZAG]


def _number(out: BitSink, v: int, size: int) -> None:
    out.put(v if v >= 0 else v + (1 << size) - 1, size)


def _block(out: BitSink, c: list[int], before: int, dc: Huffman, ac: Huffman) -> None:
    size = abs(c[0] - before).bit_length()
    dc.put(out, size)
    _number(out, c[0] - before, size)
    run = 0
    last = max((k for k in range(1, 64) if c[k]), default=0)
    for v in c[1 : last + 1]:
        if not v:
            run += 1
            continue
        for _ in range(run >> 4):
            ac.put(out, 0xF0)
        size = abs(v).bit_length()
        ac.put(out, (run & 15) << 4 | size)
        _number(out, v, size)
        run = 0
    if last < 63:
        ac.put(out, 0)


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def encode(y: np.ndarray, u: np.ndarray, v: np.ndarray, quality: int = 75) -> bytes:
    """A file of full-range planes; chroma planes have half the size, rounded up."""
    h, w = y.shape
    if (u.shape, v.shape) != (((h + 1) // 2, (w + 1) // 2),) * 2 or not 0 < h < 65536 or not 0 < w < 65536:
        raise ValueError("the planes do not fit together")
    quant = quantisers(quality)
    parts = [_blocks(y, quant[0], 16), _blocks(u, quant[1], 8), _blocks(v, quant[1], 8)]
    tables = [[Huffman.canonical(*t) for t in pair] for pair in ((LUMA_DC, LUMA_AC), (CHROMA_DC, CHROMA_AC))]
    out, before = BitSink(), [0, 0, 0]
    for row in range(parts[1].shape[0]):
        for column in range(parts[1].shape[1]):
            cells = [(0, 2 * row + i // 2, 2 * column + i % 2) for i in range(4)] + [(1, row, column), (2, row, column)]
            for k, r, c in cells:
                own = parts[k][r, c].tolist()
                _block(out, own, before[k], *tables[min(k, 1)])
                before[k] = own[0]
    if out.n:
        out.put((1 << 8 - out.n) - 1, 8 - out.n)
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    head += b"".join(_segment(0xDB, bytes([i]) + q[ZIGZAG].astype(np.uint8).tobytes()) for i, q in enumerate(quant))
    head += _segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    for kind, pair in ((0, (LUMA_DC, CHROMA_DC)), (0x10, (LUMA_AC, CHROMA_AC))):
        head += b"".join(_segment(0xC4, bytes([kind | i]) + counts + symbols) for i, (counts, symbols) in enumerate(pair))
    scan = _segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0]))
    return head + scan + out.bytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9"
