"""ADPCM both ways: IMA and Microsoft blocks, the continuous Yamaha form, and QuickTime's IMA4 sub-blocks."""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Callable

import numpy as np

# Fixed values of the three formats.
IMA_INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)
IMA_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
MS_ADAPT = (230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230)
MS_COEFFICIENTS = ((256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232))
YAMAHA_DIFF = (1, 3, 5, 7, 9, 11, 13, 15)
YAMAHA_SCALE = (230, 230, 230, 230, 307, 409, 512, 614)
BLOCK_BYTES, MS_FIRST_DELTA, IMA4_BYTES, IMA4_FRAMES = 1024, 16, 34, 64


def _clip(x: int) -> int:
    return max(-32768, min(32767, x))


def ima_size(step: int, n: int) -> int:
    """How far a nibble moves the predictor."""
    return (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)


# By step index: how far each of the 16 nibbles moves the predictor, and the greatest distances that the first seven sizes are nearest to.
_IMA_MOVES = tuple(tuple(-ima_size(s, n & 7) if n & 8 else ima_size(s, n) for n in range(16)) for s in IMA_STEPS)
_IMA_LIMITS = tuple(tuple((ima_size(s, n) + ima_size(s, n + 1)) // 2 for n in range(7)) for s in IMA_STEPS)
_IMA_NEXT = tuple(tuple(max(0, min(88, i + IMA_INDEX[n & 7])) for n in range(16)) for i in range(len(IMA_STEPS)))


def ima_code(predictor: int, index: int, sample: int) -> int:
    """The nibble whose step comes nearest to a sample, the smaller of two."""
    d = _clip(sample) - predictor
    return 8 | bisect_left(_IMA_LIMITS[index], -d) if d < 0 else bisect_left(_IMA_LIMITS[index], d)


def _settled(x: np.ndarray, period: int = 1) -> int:
    """From where on the values repeat with a period."""
    other = np.flatnonzero(x[period:] != x[:-period])
    return int(other[-1]) + 1 if len(other) else 0


def _ima_samples(codes: np.ndarray, p: int, i: int) -> tuple[list[int], int, int]:
    """The samples of a run of nibbles, and the state behind it; where equal nibbles leave the state as it is, it stays."""
    out, same = [], _settled(codes)
    for k, n in enumerate(codes.tolist()):
        q, j = p + _IMA_MOVES[i][n], _IMA_NEXT[i][n]
        q = -32768 if q < -32768 else 32767 if q > 32767 else q
        if k >= same and q == p and j == i:
            return out + [p] * (len(codes) - k), p, i
        out.append(q)
        p, i = q, j
    return out, p, i


def _ima_codes(samples: np.ndarray, p: int, i: int) -> tuple[list[int], int, int]:
    """The nibbles of a run of samples, and the state behind it; where equal samples leave the state as it is, it stays."""
    out, same = [], _settled(samples)
    for k, x in enumerate(np.clip(samples, -32768, 32767).tolist()):
        n = ima_code(p, i, x)
        q, j = p + _IMA_MOVES[i][n], _IMA_NEXT[i][n]
        q = -32768 if q < -32768 else 32767 if q > 32767 else q
        if k >= same and q == p and j == i:
            return out + [n] * (len(samples) - k), p, i
        out.append(n)
        p, i = q, j
    return out, p, i


def _nibbles(raw: bytes) -> np.ndarray:
    """The low and then the high nibble of each byte."""
    b = np.frombuffer(raw, np.uint8)
    return np.stack([b & 15, b >> 4], axis=1).reshape(-1)


def _packed(codes: list[int] | np.ndarray) -> bytes:
    """An even number of nibbles as bytes, the low one first."""
    n = np.array(codes, np.uint8)
    return (n[::2] | n[1::2] << 4).tobytes()


def ima_block(block: bytes, channels: int, frames: int) -> np.ndarray:
    out = np.zeros((frames, channels), np.int32)
    body = block[4 * channels :]
    for c in range(channels):
        p, i = int.from_bytes(block[4 * c : 4 * c + 2], "little", signed=True), min(88, block[4 * c + 2])
        out[0, c] = p
        own = body if channels == 1 else b"".join(body[word : word + 4] for word in range(c * 4, len(body), 4 * channels))
        x, _, _ = _ima_samples(_nibbles(own)[: frames - 1], p, i)
        out[1 : len(x) + 1, c] = x
    return out


def _quotient(a: int, b: int) -> int:
    """a / b towards zero."""
    return a // b if (a < 0) == (b < 0) else -(-a // b)


class MsState:
    """One channel of Microsoft ADPCM."""

    def __init__(self, coefficients: tuple[int, int], delta: int, last: int, before: int):
        self.a, self.b = coefficients
        self.delta, self.last, self.before = delta, last, before

    def predicted(self) -> int:
        return _quotient(self.last * self.a + self.before * self.b, 256)

    def expand(self, n: int) -> int:
        s = _clip(self.predicted() + (n - 16 if n > 7 else n) * self.delta)
        self.before, self.last = self.last, s
        self.delta = max(16, MS_ADAPT[n] * self.delta >> 8)
        return s

    def code(self, sample: int) -> int:
        """The nibble nearest to a sample; the state moves on."""
        d = _clip(sample) - self.predicted()
        half = self.delta // 2
        n = max(-8, min(7, _quotient(d + half if d >= 0 else d - half, self.delta))) & 15
        self.expand(n)
        return n

    def run(self, step: Callable[[int], int], x: np.ndarray) -> list[int]:
        """What ``step`` (expand or code) gives for each value; once equal or alternating values lead back to a state, the rest repeats what came since."""
        out, same, seen = [], _settled(x, 2), {}
        for k, v in enumerate(x.tolist()):
            if k >= same:
                state = k & 1, self.delta, self.last, self.before
                if state in seen:
                    rest, turn = len(x) - k, out[seen[state] :]
                    _, self.delta, self.last, self.before = list(seen)[seen[state] - same + rest % len(turn)]
                    return out + turn * (rest // len(turn)) + turn[: rest % len(turn)]
                seen[state] = k
            out.append(step(v))
        return out


def ms_block(block: bytes, channels: int, frames: int, coefficients: tuple = MS_COEFFICIENTS) -> np.ndarray:
    out = np.zeros((frames, channels), np.int32)
    k = channels
    short = lambda at: int.from_bytes(block[at : at + 2], "little", signed=True)
    states = []
    for c in range(k):
        pair = coefficients[min(block[c], len(coefficients) - 1)]
        states.append(MsState(pair, short(k + 2 * c), short(3 * k + 2 * c), short(5 * k + 2 * c)))
        out[0, c] = states[c].before
        out[1:2, c] = states[c].last
    codes = _nibbles(block[7 * k :]).reshape(-1, 2)[:, ::-1].reshape(-1)[: max(0, frames - 2) * k]
    for c in range(k):
        x = states[c].run(states[c].expand, codes[c::k])
        out[2 : len(x) + 2, c] = x
    return out


def ms_encode_block(pcm: np.ndarray, deltas: list[int]) -> bytes:
    """One block of at least two frames by channels under the first predictor; ``deltas`` holds and keeps the step sizes."""
    channels = pcm.shape[1]
    rows = np.clip(pcm, -32768, 32767)
    first, second = rows[0].tolist(), rows[1].tolist()
    states = [MsState(MS_COEFFICIENTS[0], max(16, min(32767, deltas[c])), second[c], first[c]) for c in range(channels)]
    short = lambda v: int(v).to_bytes(2, "little", signed=True)
    head = bytes(channels) + b"".join(short(s.delta) for s in states) + b"".join(map(short, second)) + b"".join(map(short, first))
    codes = np.zeros(-(-(len(rows) - 2) * channels // 2) * 2, np.uint8)
    for c, s in enumerate(states):
        codes[c : (len(rows) - 2) * channels : channels] = s.run(s.code, rows[2:, c])
    deltas[:] = [s.delta for s in states]
    return head + _packed(codes.reshape(-1, 2)[:, ::-1].reshape(-1))


class YamahaState:
    def __init__(self):
        self.last, self.step = 0, 127

    def expand(self, n: int) -> int:
        d = self.step * YAMAHA_DIFF[n & 7] // 8
        self.last = _clip(self.last - d if n & 8 else self.last + d)
        self.step = max(127, min(24576, self.step * YAMAHA_SCALE[n & 7] >> 8))
        return self.last

    def code(self, sample: int) -> int:
        d = _clip(sample) - self.last
        n = min(7, abs(d) * 4 // self.step) + (8 if d < 0 else 0)
        self.expand(n)
        return n


def yamaha(raw: bytes, channels: int) -> np.ndarray:
    states = [YamahaState() for _ in range(channels)]
    codes = [n for b in raw for n in (b & 15, b >> 4)]
    codes = codes[: len(codes) // channels * channels]
    return np.array([states[i % channels].expand(n) for i, n in enumerate(codes)], np.int32).reshape(-1, channels)


def yamaha_encode(pcm: np.ndarray) -> bytes:
    """The low nibble of a byte comes first; a last lone nibble is followed by a zero."""
    states = [YamahaState() for _ in range(pcm.shape[1])]
    codes = [s.code(x) for row in pcm.tolist() for s, x in zip(states, row, strict=True)]
    codes += [0] * (len(codes) % 2)
    return bytes(a | b << 4 for a, b in zip(codes[::2], codes[1::2], strict=True))


def ima4(raw: bytes, channels: int) -> np.ndarray:
    """Sub-blocks of 64 samples a channel; the state runs on from the first and the preambles are not read."""
    states, parts = [(0, 0)] * channels, []
    for at in range(0, len(raw) - IMA4_BYTES * channels + 1, IMA4_BYTES * channels):
        own = np.zeros((IMA4_FRAMES, channels), np.int32)
        for c in range(channels):
            own[:, c], p, i = _ima_samples(_nibbles(raw[at + IMA4_BYTES * c + 2 : at + IMA4_BYTES * (c + 1)]), *states[c])
            states[c] = p, i
        parts.append(own)
    return np.concatenate(parts) if parts else np.zeros((0, channels), np.int32)


def ima4_encode(pcm: np.ndarray) -> bytes:
    """Whole sub-blocks, the last filled up with its last frame; a preamble is the state's upper 9 bits and its index."""
    channels = pcm.shape[1]
    states, out = [(0, 0)] * channels, []
    for a in range(0, len(pcm), IMA4_FRAMES):
        rows = pcm[a : a + IMA4_FRAMES]
        rows = np.concatenate([rows, np.repeat(rows[-1:], IMA4_FRAMES - len(rows), axis=0)])
        for c in range(channels):
            p, i = states[c]
            out.append(((p & 0xFF80) | i).to_bytes(2, "big"))
            codes, p, i = _ima_codes(rows[:, c], p, i)
            states[c] = p, i
            out.append(_packed(codes))
    return b"".join(out)


def frames_per_block(kind: str, channels: int, block: int = BLOCK_BYTES) -> int:
    if kind == "ima":
        return (block - 4 * channels) * 8 // (4 * channels) + 1
    return 2 + (block - 7 * channels) * 2 // channels


def encode(pcm: np.ndarray, kind: str, block: int = BLOCK_BYTES) -> bytes:
    """All frames by channels; the last block is filled up with silence."""
    pcm = np.asarray(pcm)
    channels = pcm.shape[1]
    if kind == "yamaha":
        return yamaha_encode(pcm)
    size = frames_per_block(kind, channels, block)
    state, out = [0 if kind == "ima" else MS_FIRST_DELTA] * channels, []
    for a in range(0, len(pcm), size):
        rows = pcm[a : a + size]
        rows = np.concatenate([rows, np.zeros((size - len(rows), channels), rows.dtype)])
        out.append(ima_encode_block(rows, state) if kind == "ima" else ms_encode_block(rows, state))
    return b"".join(out)


def decode(raw: bytes, kind: str, channels: int, block: int, frames: int, coefficients: tuple = ()) -> np.ndarray:
    """All frames of a stream of blocks; a last block may be shorter."""
    if kind in ("yamaha", "ima4"):
        return (yamaha if kind == "yamaha" else ima4)(raw, channels)
    one = ima_block if kind == "ima" else functools.partial(ms_block, coefficients=coefficients or MS_COEFFICIENTS)
    parts = [one(raw[a : a + block], channels, frames) for a in range(0, len(raw), block) if len(raw[a : a + block]) >= (4 if kind == "ima" else 7) * channels]
    return np.concatenate(parts) if parts else np.zeros((0, channels), np.int32)


def ima_encode_block(pcm: np.ndarray, index: list[int]) -> bytes:
    """One block of frames by channels; ``index`` holds and keeps each channel's step index."""
    channels = pcm.shape[1]
    head, words = b"", []
    for c in range(channels):
        p, i = _clip(int(pcm[0, c])), index[c]
        head += p.to_bytes(2, "little", signed=True) + bytes([i, 0])
        codes, _, index[c] = _ima_codes(pcm[1:, c], p, i)
        words.append(_packed(codes + [0] * (-len(codes) % 8)))
    return head + b"".join(own[a : a + 4] for a in range(0, len(words[0]), 4) for own in words)
