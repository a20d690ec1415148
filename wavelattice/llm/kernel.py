"""Vectorised tokenising and hashing of Arrow text columns with numpy.

Texts are handled as UTF-8 bytes in slices of about a megabyte, so memory is
bounded by the slice (or by the longest single text) and temporaries stay in
cache. Word hashes are 64-bit: a polynomial over random byte codes, which is
computed for all words of a slice from one running sum, then mixed. Such a
polynomial has known collisions between long words; words of more than
``LONG_RUN`` bytes are therefore hashed with BLAKE2b one by one.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
LONG_RUN = 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER_CODES = _CODES[LOWER]
EXACT_CODES = _CODES

_powers: dict[str, np.ndarray] = {}


_caches: list[Callable[[], None]] = []


def on_settle(clear: Callable[[], None]) -> None:
    """Have ``clear`` called when another operator needs this worker's memory."""
    _caches.append(clear)


def _trim() -> None:
    """Give memory that is free in this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(f: Callable) -> Callable:
    """``f`` over Arrow batches in a worker that other operators used before: their caches go, free memory is given back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for clear in _caches:
            clear()
        _trim()
        yield from f(batches)
        _trim()

    return run


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    key = str(base)
    if key not in _powers or len(_powers[key]) <= n:
        out = np.full(max(n, SLICE_BYTES) + 2, U(base))
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[key] = out
    return _powers[key]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) in runs of rows of about ``size`` bytes."""
    raw, offsets = text_buffers(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes that cross no text border."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = member
    borders = offsets[(offsets > 0) & (offsets < n)]
    prev = before[:-1].copy()
    prev[borders] = False
    starts = np.flatnonzero(member & ~prev)
    follow = np.empty(n, dtype=bool)
    follow[:-1] = member[1:]
    follow[-1] = False
    follow[borders - 1] = False
    return starts, np.flatnonzero(member & ~follow) + 1


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """One hash for each run of bytes, equal for equal runs of coded bytes (LOWER_CODES or EXACT_CODES)."""
    n = len(raw)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes[raw] * _power(_BASE, n)[:n], out=total[1:])
    size = ends - starts
    h = mix((total[ends] - total[starts]) * _power(_INVERSE, n)[starts] + size.astype(np.uint64))
    for i in np.flatnonzero(size > LONG_RUN).tolist():
        run = raw[starts[i] : ends[i]]
        run = (LOWER[run] if codes is LOWER_CODES else run).tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little")
    return h


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all white-space separated words, A-Z lower-cased, and each text's word offsets."""
    starts, ends = runs(~SPACE[raw], offsets)
    return run_hashes(raw, starts, ends, LOWER_CODES), np.searchsorted(starts, offsets)


_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * U(0xA24BAED4963EE407)) | U(1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``width``-word shingles, sorted and distinct within a text, and n+1 bounds.

    A text of fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    n_texts, n_words = len(bounds) - 1, np.diff(bounds)
    m = len(hashes) - width + 1
    if m > 0:
        full = np.zeros(m, np.uint64)
        for k in range(width):
            full += hashes[k : k + m] * _PLACE[k]
        full = mix(full)
    else:
        full = np.zeros(0, np.uint64)
    out, sizes = [], np.zeros(n_texts, np.int64)
    for i in range(n_texts):
        a, k = int(bounds[i]), int(n_words[i])
        if k >= width:
            s = np.sort(full[a : a + k - width + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif k:
            s = mix((hashes[a : a + k] * _PLACE[:k]).sum(dtype=np.uint64, keepdims=True) + U(k))
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    ends = np.zeros(n_texts + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), ends
