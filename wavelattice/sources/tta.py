"""True Audio files: 16-bit mono and stereo, frames that decode on their own."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from wavelattice.sources.bitio import BitSink, BitTap

# Fixed values of the format: taps, filter shift and predictor shift at 16 bits, first Rice parameter, frame length.
TAPS, FILTER_SHIFT, PREDICTOR_SHIFT, FIRST_K = 8, 9, 5, 10
FRAME_SECONDS = (256, 245)
HEADER = struct.Struct("<4sHHHII")


def frame_length(rate: int) -> int:
    return rate * FRAME_SECONDS[0] // FRAME_SECONDS[1]


class _Filter:
    """The sign-adaptive filter before the fixed predictor; ``memory`` holds differences of the last values."""

    def __init__(self):
        self.weights, self.steps, self.memory, self.error = [0] * TAPS, [0] * TAPS, [0] * TAPS, 0

    def guess(self) -> int:
        """What the filter adds to the next residual, after learning from the last one."""
        w, d, m = self.weights, self.steps, self.memory
        if self.error:
            sign = 1 if self.error > 0 else -1
            self.weights = w = [a + sign * b for a, b in zip(w, d, strict=True)]
        total = (1 << FILTER_SHIFT - 1) + sum(a * b for a, b in zip(m, w, strict=True))
        # The four newest steps follow the signs of the memory, with sizes 1, 2, 2 and 4.
        fresh = [size if m[4 + i] >= 0 else -size for i, size in enumerate((1, 2, 2, 4))]
        self.steps = d[1:5] + fresh
        return total >> FILTER_SHIFT

    def learn(self, value: int, residual: int) -> None:
        m = self.memory
        first = value - m[7]
        second = first - m[6]
        self.memory = [*m[1:5], second - m[5], second, first, value]
        self.error = residual


class _Rice:
    """Two adaptive parameters: one for all residuals, one for what exceeds it."""

    def __init__(self):
        self.k, self.total = [FIRST_K, FIRST_K], [1 << FIRST_K + 4] * 2

    def adapt(self, which: int, value: int) -> None:
        k = self.k[which]
        total = self.total[which] = self.total[which] + value - (self.total[which] >> 4)
        if k and total < 1 << k + 4:
            self.k[which] = k - 1
        elif total > 1 << k + 5:
            self.k[which] = k + 1

    def put(self, out: BitSink, residual: int) -> None:
        value = 2 * residual - 1 if residual > 0 else -2 * residual
        k = self.k[0]
        self.adapt(0, value)
        if value >= 1 << k:
            value -= 1 << k
            k = self.k[1]
            self.adapt(1, value)
            out.ones(1 + (value >> k))
        out.put(0, 1)
        out.put(value, k)

    def take(self, bits: BitTap) -> int:
        ones = bits.ones()
        which = 1 if ones else 0
        k = self.k[which]
        value = (max(ones - 1, 0) << k) + bits.take(k)
        if which:
            self.adapt(1, value)
            value += 1 << self.k[0]
        self.adapt(0, value)
        return (value + 1) // 2 if value & 1 else -(value // 2)


class _Channel:
    def __init__(self):
        self.rice, self.filter, self.last = _Rice(), _Filter(), 0

    def predicted(self) -> int:
        return (self.last << PREDICTOR_SHIFT) - self.last >> PREDICTOR_SHIFT

    def put(self, out: BitSink, x: int) -> None:
        value = x - self.predicted()
        self.last = x
        residual = value - self.filter.guess()
        self.filter.learn(value, residual)
        self.rice.put(out, residual)

    def take(self, bits: BitTap) -> int:
        residual = self.rice.take(bits)
        value = residual + self.filter.guess()
        self.filter.learn(value, residual)
        self.last = value + self.predicted()
        return self.last


def _half(x: int) -> int:
    """Half of a number, towards zero."""
    return x // 2 if x >= 0 else -(-x // 2)


def encode_frame(pcm: np.ndarray) -> bytes:
    """One frame of samples (frames by one or two channels)."""
    out, states = BitSink(lsb=True), [_Channel() for _ in range(pcm.shape[1])]
    for row in pcm.tolist():
        if len(row) == 2:
            side = row[1] - row[0]
            row = [side, row[1] - _half(side)]
        for state, x in zip(states, row, strict=True):
            state.put(out, x)
    return out.bytes()


def decode_frame(data: bytes, channels: int, frames: int) -> np.ndarray:
    bits, states = BitTap(data, lsb=True), [_Channel() for _ in range(channels)]
    out = []
    for _ in range(frames):
        row = [s.take(bits) for s in states]
        if channels == 2:
            right = row[1] + _half(row[0])
            row = [right - row[0], right]
        out.append(row)
    return np.array(out, np.int32).reshape(-1, channels)


def _checked(data: bytes) -> bytes:
    return data + struct.pack("<I", zlib.crc32(data))


def encode(pcm: np.ndarray, rate: int) -> bytes:
    """A file of 16-bit samples (frames by channels)."""
    pcm = np.asarray(pcm)
    if pcm.shape[1] not in (1, 2) or len(pcm) and (pcm.min() < -32768 or pcm.max() > 32767):
        raise ValueError("one or two channels of 16 bits are supported")
    size = frame_length(rate)
    frames = [_checked(encode_frame(pcm[a : a + size])) for a in range(0, len(pcm), size)]
    head = HEADER.pack(b"TTA1", 1, pcm.shape[1], 16, rate, len(pcm))
    return _checked(head) + _checked(struct.pack(f"<{len(frames)}I", *map(len, frames))) + b"".join(frames)


def _verified(raw: bytes, at: int, size: int, what: str) -> bytes:
    if at + size + 4 > len(raw):
        raise ValueError(f"the file ends within its {what}")
    data = raw[at : at + size]
    if struct.unpack_from("<I", raw, at + size)[0] != zlib.crc32(data):
        raise ValueError(f"the {what} fails its checksum")
    return data


def info(raw: bytes) -> tuple[int, int, int, int]:
    """Channels, rate, bits and frames."""
    magic, kind, channels, bits, rate, total = HEADER.unpack(_verified(raw, 0, HEADER.size, "header"))
    if magic != b"TTA1":
        raise ValueError("not TTA")
    if kind != 1 or bits != 16 or channels not in (1, 2) or not frame_length(rate):
        raise ValueError("one or two channels of 16-bit PCM are supported")
    return channels, rate, bits, total


def decode(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples; all checksums are verified."""
    channels, rate, _, total = info(raw)
    size, at = frame_length(rate), HEADER.size + 4
    count = -(-total // size)
    table = struct.unpack(f"<{count}I", _verified(raw, at, 4 * count, "seek table"))
    at, out = at + 4 * count + 4, []
    for i, n in enumerate(table):
        if n < 4:
            raise ValueError(f"frame {i} is too short")
        out.append(decode_frame(_verified(raw, at, n - 4, f"frame {i}"), channels, min(size, total - i * size)))
        at += n
    return rate, np.concatenate(out) if out else np.zeros((0, channels), np.int32)
