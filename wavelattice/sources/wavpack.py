"""WavPack files: lossless mono and stereo of 16 and 24 bits, blocks that decode on their own."""

from __future__ import annotations

import math
import struct

import numpy as np

from wavelattice.sources.bitio import BitSink, BitTap

HEADER = struct.Struct("<4sIHBBIIIII")
# Fixed values of the format: sample rates by index, sub-block ids, flag places, adaptation of the medians.
RATES = (6000, 8000, 9600, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000, 192000)
TERMS, WEIGHTS, HISTORY, MEDIANS, INT32, BITSTREAM, RATE = 2, 3, 4, 5, 9, 10, 0x27
MONO, HYBRID, JOINT, FLOAT, EXTENDED, INITIAL, FINAL, FALSE_STEREO, DSD = (1 << i for i in (2, 3, 4, 7, 8, 11, 12, 30, 31))
DIVISORS, MOST_ONES = (128, 64, 32), 16
# The encoder's choice: terms of its cascade, first pass first, step of the weights, frames a block.
CASCADE, DELTA, BLOCK_FRAMES = (18, 17, 2, 3, 1), 2, 11025


def exp2(x: int) -> int:
    """The number whose logarithm (8 fractional bits, one more than the exponent) is given; odd in x."""
    if x < 0:
        return -exp2(-x)
    mantissa, exponent = 256 + round(256 * (2 ** ((x & 255) / 256) - 1)), x >> 8
    return mantissa >> 9 - exponent if exponent <= 9 else mantissa << exponent - 9


def log2(v: int) -> int:
    """The inverse of exp2, as near as its 8 bits allow."""
    if v < 0:
        return -log2(-v)
    v += v >> 9
    n = v.bit_length()
    return (n << 8) + round(256 * math.log2(1 + ((v << 9 - n if n < 9 else v >> n - 9) & 255) / 256)) if v else 0


class _Words:
    """The medians of each channel, which say how a residual is coded."""

    def __init__(self, medians: list[list[int]]):
        self.medians = medians

    def quiet(self) -> bool:
        return all(m[0] < 2 for m in self.medians)

    def silence(self) -> None:
        for m in self.medians:
            m[:] = [0, 0, 0]

    def width(self, c: int, i: int) -> int:
        return (self.medians[c][i] >> 4) + 1

    def grow(self, c: int, i: int) -> None:
        m = self.medians[c]
        m[i] += (m[i] + DIVISORS[i]) // DIVISORS[i] * 5

    def shrink(self, c: int, i: int) -> None:
        m = self.medians[c]
        m[i] -= (m[i] + DIVISORS[i] - 2) // DIVISORS[i] * 2

    def zone(self, c: int, number: int) -> tuple[int, int]:
        """First value and size of a zone: the three medians' one after the other, then more of the last size."""
        low = 0
        for i in range(3):
            size = self.width(c, i)
            if number == i:
                self.shrink(c, i)
                return low, size
            if i == 2:
                low += (number - 2) * size
            self.grow(c, i)
            if i < 2:
                low += size
        return low, size

    def zone_of(self, c: int, value: int) -> int:
        a, b, rest = self.width(c, 0), self.width(c, 1), self.width(c, 2)
        return 0 if value < a else 1 if value < a + b else 2 + (value - a - b) // rest


def _put_count(out: BitSink, n: int) -> None:
    """A number as its length in ones, a zero and its bits below the highest."""
    size = n.bit_length()
    out.ones(size)
    out.put(0, 1)
    out.put(n, max(0, size - 1))


def _take_count(bits: BitTap) -> int:
    size = bits.ones(33)
    if size == 33:
        raise ValueError("a count is too long")
    return size if size < 2 else 1 << size - 1 | bits.take(size - 1)


def put_words(out: BitSink, residuals: list[int], channels: int, words: _Words) -> None:
    """Code interleaved residuals.

    A zone's number is sent as ones and a zero; two neighbours share a code
    word: if the first zone is followed by another than the first, the word's
    lowest one says so, and the neighbour's number starts one lower.
    """
    zeros, held, pending = 0, None, BitSink(lsb=True)

    def flush(extra: int) -> None:
        """Send the held zone number, doubled, with ``extra``, and what waits behind it."""
        nonlocal held, pending
        ones = held + extra
        if ones >= MOST_ONES:
            out.ones(MOST_ONES)
            out.put(0, 1)
            _put_count(out, ones - MOST_ONES)
        else:
            out.ones(ones)
            out.put(0, 1)
        value, n = int.from_bytes(pending.bytes(), "little"), 8 * len(pending.done) + pending.n
        for a in range(0, n, 24):
            out.put(value >> a, min(24, n - a))
        held, pending = None, BitSink(lsb=True)

    for i, r in enumerate(residuals):
        c = i % channels
        if held is None and words.quiet():
            if r == 0:
                if not zeros:
                    words.silence()
                zeros += 1
                continue
            _put_count(out, zeros)
            zeros = 0
        value = ~r if r < 0 else r
        number = words.zone_of(c, value)
        low, size = words.zone(c, number)
        if held is None:
            held = 2 * number
        else:
            flush(int(number > 0))
            if number:
                held = 2 * (number - 1)
        own = pending if held is not None else out
        if size > 1:
            length = (size - 1).bit_length()
            spare, code = (1 << length) - size, value - low
            if code < spare:
                own.put(code, length - 1)
            else:
                own.put(code + spare >> 1, length - 1)
                own.put(code + spare & 1, 1)
        own.put(int(r < 0), 1)
    if zeros:
        _put_count(out, zeros)
    if held is not None:
        flush(0)


def take_words(bits: BitTap, n: int, channels: int, words: _Words) -> list[int]:
    out: list[int] = []
    zeros, shared, lowest = 0, False, 0  # shared: the next zone is the first; lowest: the last word was odd
    while len(out) < n:
        c = len(out) % channels
        if not shared and not lowest and words.quiet():
            if zeros:
                zeros -= 1
            else:
                zeros = _take_count(bits)
                if zeros:
                    words.silence()
            if zeros:
                out.append(0)
                continue
        if shared:
            number, shared = 0, False
        else:
            ones = bits.ones(MOST_ONES + 1)
            if ones == MOST_ONES + 1:
                raise ValueError("a code word is too long")
            if ones == MOST_ONES:
                ones += _take_count(bits)
            number = (ones >> 1) + lowest
            lowest = ones & 1
            shared = not lowest
        low, size = words.zone(c, number)
        if size > 1:
            length = (size - 1).bit_length()
            spare = (1 << length) - size
            code = bits.take(length - 1)
            if code >= spare:
                code = 2 * code - spare + bits.take(1)
            low += code
        out.append(~low if bits.take(1) else low)
    return out


class _Pass:
    """One step of the cascade over one or two channels."""

    def __init__(self, term: int, delta: int, channels: int):
        if not (1 <= term <= 8 or term in (17, 18) or -3 <= term <= -1 and channels == 2):
            raise ValueError(f"term {term} is not supported")
        self.term, self.delta = term, delta
        self.weights = [0] * channels
        self.past = [[0] * (1 if term < 0 else min(term, 2) if term > 8 else term) for _ in range(channels)]
        if term > 8:
            self.past = [[0, 0] for _ in range(channels)]

    def guess(self, c: int) -> int:
        p = self.past[c]
        if self.term == 17:
            return 2 * p[0] - p[1]
        if self.term == 18:
            return 3 * p[0] - p[1] >> 1
        return p[0]

    def step(self, c: int, base: int, x: int, decode: bool) -> tuple[int, int]:
        """Sample and residual of one channel predicted from ``base``."""
        by = self.weights[c] * base + 512 >> 10
        sample, residual = (x + by, x) if decode else (x, x - by)
        if base and residual:
            self.weights[c] += self.delta if (base < 0) == (residual < 0) else -self.delta
            if self.term < 0:
                self.weights[c] = max(-1024, min(1024, self.weights[c]))
        return sample, residual

    def run(self, rows: list[list[int]], decode: bool) -> list[list[int]]:
        out, pick = [], 0 if decode else 1
        for row in rows:
            if self.term < 0:
                # The second of the two is predicted from the first one's new sample (-1, -2) or its old one (-3).
                a, b = (1, 0) if self.term == -2 else (0, 1)
                first = self.step(a, self.past[a][0], row[a], decode)
                second = self.step(b, self.past[b][0] if self.term == -3 else first[0], row[b], decode)
                pair = [None, None]
                pair[a], pair[b] = first, second
                if self.term == -3:
                    self.past[0][0], self.past[1][0] = pair[1][0], pair[0][0]
                else:
                    self.past[a][0] = second[0]
                out.append([p[pick] for p in pair])
                continue
            new = []
            for c, x in enumerate(row):
                both = self.step(c, self.guess(c), x, decode)
                p = self.past[c]
                if self.term > 8:
                    p[1], p[0] = p[0], both[0]
                else:
                    p.append(both[0])
                    del p[0]
                new.append(both[pick])
            out.append(new)
        return out


def checksum(rows: np.ndarray) -> int:
    """Each frame's samples in turn: three times the sum so far, plus the sample."""
    total = 0xFFFFFFFF
    for x in rows.reshape(-1).tolist():
        total = total * 3 + x & 0xFFFFFFFF
    return total


def _sub(kind: int, body: bytes) -> bytes:
    words, odd = len(body) + 1 >> 1, len(body) & 1
    head = bytes([kind | odd << 6, words]) if words < 256 else bytes([kind | odd << 6 | 0x80]) + words.to_bytes(3, "little")
    return head + body + bytes(odd)


def encode_block(pcm: np.ndarray, at: int, total: int, rate: int, bits: int) -> bytes:
    """One block of frames by channels that starts at frame ``at`` of ``total``."""
    channels = pcm.shape[1]
    rows = pcm.tolist()
    flags = bits // 8 - 1 | INITIAL | FINAL | (MONO if channels == 1 else JOINT)
    index = RATES.index(rate) if rate in RATES else 15
    flags |= index << 23 | int(np.abs(pcm.astype(np.int64)).max(initial=0)).bit_length() << 18
    if channels == 2:
        rows = [[a - b, b + (a - b >> 1)] for a, b in rows]
    for term in CASCADE:
        rows = _Pass(term, DELTA, channels).run(rows, False)
    out = BitSink(lsb=True)
    put_words(out, [x for row in rows for x in row], channels, _Words([[0, 0, 0] for _ in range(channels)]))
    body = _sub(TERMS, bytes(t + 5 | DELTA << 5 for t in CASCADE)) + _sub(WEIGHTS, bytes(len(CASCADE) * channels)) + _sub(MEDIANS, bytes(6 * channels))
    if index == 15:
        body += _sub(RATE, rate.to_bytes(3, "little"))
    body += _sub(BITSTREAM, out.bytes())
    return HEADER.pack(b"wvpk", HEADER.size - 8 + len(body), 0x403, 0, 0, total, at, len(pcm), flags, checksum(pcm)) + body


def encode(pcm: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A file of samples (frames by one or two channels); there must be some."""
    pcm = np.asarray(pcm)
    if not len(pcm) or pcm.shape[1] not in (1, 2) or bits not in (16, 24):
        raise ValueError("some frames of one or two channels of 16 or 24 bits are needed")
    return b"".join(encode_block(pcm[a : a + BLOCK_FRAMES], a, len(pcm), rate, bits) for a in range(0, len(pcm), BLOCK_FRAMES))


def _parts(raw: bytes) -> dict[int, bytes]:
    at, out = 0, {}
    while at + 2 <= len(raw):
        kind, words, at = raw[at], raw[at + 1], at + 2
        if kind & 0x80:
            words, at = words | int.from_bytes(raw[at : at + 2], "little") << 8, at + 2
        if at + 2 * words > len(raw):
            raise ValueError("a part runs past the end")
        out[kind & 0x3F] = raw[at : at + 2 * words - (kind >> 6 & 1)]
        at += 2 * words
    return out


def decode_block(raw: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, bits and samples of one block; its checksum is verified."""
    _, _, _, _, _, _, _, frames, flags, check = HEADER.unpack_from(raw)
    if flags & (HYBRID | FLOAT | DSD) or flags & (INITIAL | FINAL) != INITIAL | FINAL:
        raise ValueError("only lossless integer blocks of one or two channels are supported")
    channels = 1 if flags & (MONO | FALSE_STEREO) else 2
    parts = _parts(raw[HEADER.size :])
    shorts = lambda kind: [exp2(x[0]) for x in struct.iter_unpack("<h", parts.get(kind, b""))]
    # Terms are listed in the order of encoding, the last first to be undone.
    passes = [_Pass((b & 31) - 5, b >> 5, channels) for b in parts.get(TERMS, b"")]
    stored = parts.get(WEIGHTS, b"")
    for i, b in enumerate(stored[: len(passes) * channels]):
        w = (b - 256 if b > 127 else b) << 3
        passes[i // channels].weights[i % channels] = w + (w + 64 >> 7) if w > 0 else w
    history = shorts(HISTORY)
    for p in passes:
        if p.term > 8:
            for past in p.past:
                past[:], history = (history[:2] + [0, 0])[:2], history[2:]
        elif p.term < 0:
            for past in p.past:
                past[:], history = (history[:1] + [0])[:1], history[1:]
        else:
            for k in range(p.term):
                for past in p.past:
                    past[k], history = (history[:1] + [0])[0], history[1:]
    medians = shorts(MEDIANS) + [0] * 6
    words = _Words([medians[3 * c : 3 * c + 3] for c in range(channels)])
    flat = take_words(BitTap(parts.get(BITSTREAM, b""), lsb=True), frames * channels, channels, words)
    rows = [flat[i : i + channels] for i in range(0, len(flat), channels)]
    for p in reversed(passes):
        rows = p.run(rows, True)
    if flags & JOINT and channels == 2:
        rows = [[a + b - (a >> 1), b - (a >> 1)] for a, b in rows]
    out = np.array(rows, np.int64).reshape(-1, channels)
    if checksum(out) != check:
        raise ValueError("the block fails its checksum")
    shift = flags >> 13 & 31
    if flags & EXTENDED:
        sent, zeros, ones, copies = (parts.get(INT32, b"") + bytes(4))[:4]
        if sent or ones or copies:
            raise ValueError("this form of 32-bit samples is not supported")
        shift += zeros
    if flags & FALSE_STEREO:
        out = np.repeat(out, 2, axis=1)
    index = flags >> 23 & 15
    rate = RATES[index] if index < 15 else int.from_bytes(parts.get(RATE, b""), "little")
    return rate, ((flags & 3) + 1) * 8, (out << shift).astype(np.int32)


def decode(raw: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, bits and samples (frames by channels) of a file."""
    at, rate, bits, out = 0, 0, 16, []
    while at + HEADER.size <= len(raw) and raw[at : at + 4] == b"wvpk":
        size = struct.unpack_from("<I", raw, at + 4)[0] + 8
        if at + size > len(raw):
            raise ValueError("a block runs past the end")
        if HEADER.unpack_from(raw, at)[7]:
            rate, bits, x = decode_block(raw[at : at + size])
            out.append(x)
        at += size
    if not out:
        raise ValueError("not WavPack, or without samples")
    return rate, bits, np.concatenate(out)
