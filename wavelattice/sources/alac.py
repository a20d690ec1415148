"""Apple Lossless in Core Audio files: 16 and 24 bits, mono and stereo, packets that decode on their own."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from wavelattice.sources.bitio import BitSink, BitTap

SINGLE, PAIR, END = 0, 1, 7
PACKET_FRAMES = 4096
# What the encoder writes: extrapolation from the last two samples as the predictor's start, plain side signal.
SHIFT, MULTIPLIER, START = 9, 4, (0, 0, -512, 1024)
MIX_SHIFT, MIX_WEIGHT = 1, 1


@dataclass(frozen=True)
class Cookie:
    """The codec's configuration record."""

    frames: int
    bits: int
    channels: int
    rate: int
    pb: int = 40
    mb: int = 10
    kb: int = 14
    max_run: int = 255

    _FORM = struct.Struct(">I6BH3I")

    def pack(self) -> bytes:
        return self._FORM.pack(self.frames, 0, self.bits, self.pb, self.mb, self.kb, self.channels, self.max_run, 0, 0, self.rate)

    @classmethod
    def unpack(cls, raw: bytes) -> Cookie:
        if len(raw) < cls._FORM.size:
            raise ValueError("the configuration record is too short")
        frames, _, bits, pb, mb, kb, channels, run, _, _, rate = cls._FORM.unpack_from(raw)
        if not frames or not kb or channels not in (1, 2) or bits not in (16, 24):
            raise ValueError("one or two channels of 16 or 24 bits are supported")
        return cls(frames, bits, channels, rate, pb, mb, kb, run)


class _Golomb:
    """The state that both sides of the residual code derive alike."""

    def __init__(self, cookie: Cookie, multiplier: int, width: int):
        self.kb, self.gain, self.width, self.history, self.parity = cookie.kb, multiplier * cookie.pb // 4, width, cookie.mb, 0

    def k(self) -> int:
        return min(((self.history >> 9) + 3).bit_length() - 1, self.kb)

    def run_k(self) -> int:
        return min(7 - max(self.history.bit_length() - 1, 0) + (self.history + 16 >> 6), self.kb)

    def seen(self, folded: int) -> bool:
        """Take a folded residual into account; whether a run of zeros is coded next."""
        if folded > 0xFFFF:
            self.history = 0xFFFF
        else:
            self.history = max(0, min(0xFFFF, self.history + folded * self.gain - (self.history * self.gain >> 9)))
        return self.history < 128

    def ran(self, length: int) -> None:
        self.history, self.parity = 0, int(0 < length <= 0xFFFF)


def _put_number(out: BitSink, value: int, k: int, width: int) -> None:
    whole, rest = divmod(value, (1 << k) - 1)
    if whole > 8:
        out.put(0x1FF, 9)
        out.put(value, width)
        return
    out.put((1 << whole + 1) - 2, whole + 1)
    if k > 1:
        if rest:
            out.put(rest + 1, k)
        else:
            out.put(0, k - 1)


def _take_number(bits: BitTap, k: int, width: int) -> int:
    whole = bits.ones(9)
    if whole == 9:
        return bits.take(width)
    if k == 1:
        return whole
    value = whole * ((1 << k) - 1)
    high = bits.take(k - 1)
    if high == 0:
        return value  # a remainder of zero is one bit shorter
    return value + (high << 1 | bits.take(1)) - 1


def put_residuals(out: BitSink, residuals: list[int], cookie: Cookie, multiplier: int, width: int) -> None:
    state, i, n = _Golomb(cookie, multiplier, width), 0, len(residuals)
    while i < n:
        r = residuals[i]
        folded = 2 * r if r >= 0 else -2 * r - 1
        _put_number(out, folded - state.parity, state.k(), width)
        state.parity = 0
        i += 1
        if state.seen(folded) and i < n:
            run = next((j for j in range(i, n) if residuals[j]), n) - i
            _put_number(out, run, state.run_k(), 16)
            state.ran(run)
            i += run


def take_residuals(bits: BitTap, n: int, cookie: Cookie, multiplier: int, width: int) -> list[int]:
    state, out = _Golomb(cookie, multiplier, width), []
    while len(out) < n:
        folded = _take_number(bits, state.k(), width) + state.parity
        state.parity = 0
        out.append(-(folded + 1 >> 1) if folded & 1 else folded >> 1)
        if state.seen(folded) and len(out) < n:
            run = _take_number(bits, state.run_k(), 16)
            out += [0] * min(run, n - len(out))
            state.ran(run)
    return out


def _adapted(past: list[int], base: int, weights: list[int], residual: int, shift: int) -> None:
    """Move the weights, newest sample first, until the residual is used up."""
    sign = 1 if residual > 0 else -1
    left = abs(residual)
    for j in range(len(weights) - 1, -1, -1):
        if left <= 0:
            return
        v = base - past[j]
        if v:
            step = sign if v > 0 else -sign
            weights[j] -= step
            left -= sign * ((v * step >> shift) * (len(weights) - j))


def predict(data: list[int], weights: list[int], shift: int, forward: bool) -> list[int]:
    """Residuals of samples (``forward``), or the samples of residuals; the weights adapt on the way."""
    order = len(weights)
    if not order:
        return list(data)
    samples: list[int] = []
    out: list[int] = []
    half = 1 << shift >> 1
    for i, x in enumerate(data):
        if i < order:
            before = samples[-1] if i else 0
            sample, residual = (x, x - before) if forward else (x + before, x)
        else:
            past = samples[i - order : i]
            base = past[0]
            guess = base + (sum((s - base) * w for s, w in zip(past, weights, strict=True)) + half >> shift)
            sample, residual = (x, x - guess) if forward else (guess + x, x)
            if residual:
                _adapted(past, base, weights, residual, shift)
        samples.append(sample)
        out.append(residual if forward else sample)
    return out


def encode_packet(pcm: np.ndarray, cookie: Cookie) -> bytes:
    """One packet of samples (frames by channels); verbatim where a residual does not fit."""
    channels = [pcm[:, c].tolist() for c in range(cookie.channels)]
    width = cookie.bits + cookie.channels - 1
    mixed = channels
    if cookie.channels == 2:
        side = [a - b for a, b in zip(*channels, strict=True)]
        mixed = [[b + (d * MIX_WEIGHT >> MIX_SHIFT) for b, d in zip(channels[1], side, strict=True)], side]
    residuals = [predict(c, list(START), SHIFT, True) for c in mixed]
    limit = 1 << width - 1
    packed = all(-limit <= r < limit for own in residuals for r in own)
    out = BitSink()
    out.put(PAIR if cookie.channels == 2 else SINGLE, 3)
    out.put(0, 16)
    out.put(1, 1)  # the number of frames follows
    out.put(0, 2)
    out.put(not packed, 1)
    out.put(len(pcm), 32)
    mix = packed and cookie.channels == 2
    out.put(MIX_SHIFT if mix else 0, 8)
    out.put(MIX_WEIGHT if mix else 0, 8)
    for c in range(cookie.channels):
        if packed:
            out.put(0, 4)
            out.put(SHIFT, 4)
            out.put(MULTIPLIER, 3)
            out.put(len(START), 5)
            for w in reversed(START):
                out.put(w, 16)
            put_residuals(out, residuals[c], cookie, MULTIPLIER, width)
        else:
            for x in channels[c]:
                out.put(x, cookie.bits)
    out.put(END, 3)
    return out.bytes()


def decode_packet(data: bytes, cookie: Cookie) -> np.ndarray:
    bits = BitTap(data)
    kind = bits.take(3)
    if kind not in (SINGLE, PAIR):
        raise ValueError(f"element {kind} is not supported")
    count = kind + 1
    bits.take(16)
    sized, spare, verbatim = bits.take(1), bits.take(2), bits.take(1)
    if spare:
        raise ValueError("packets with spare low bits are not supported")
    frames = bits.take(32) if sized else cookie.frames
    shift, weight = bits.take(8), bits.take(8)
    channels = []
    for _ in range(count):
        if verbatim:
            channels.append([bits.signed(cookie.bits) for _ in range(frames)])
            continue
        mode, scale, multiplier, order = bits.take(4), bits.take(4), bits.take(3), bits.take(5)
        if mode or not scale or order == 31:
            raise ValueError("this predictor is not supported")
        weights = [bits.signed(16) for _ in range(order)][::-1]
        residuals = take_residuals(bits, frames, cookie, multiplier, cookie.bits + count - 1)
        channels.append(predict(residuals, weights, scale, False))
    if bits.take(3) != END:
        raise ValueError("the packet has no end")
    out = np.array(channels, np.int64).reshape(count, -1).T
    if weight and count == 2:
        right = out[:, 0] - (out[:, 1] * weight >> shift)
        out = np.stack([right + out[:, 1], right], axis=1)
    return out.astype(np.int32)


# Core Audio files
def _variable(n: int) -> bytes:
    """Seven bits a byte, highest first, all but the last marked."""
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(out[::-1])


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack(">q", len(body)) + body


def caf(packets: list[bytes], cookie: Cookie, frames: int) -> bytes:
    """A file of packets with their table."""
    form = struct.pack(">d4s5I", cookie.rate, b"alac", 0, 0, cookie.frames, cookie.channels, 0)
    table = struct.pack(">qqii", len(packets), frames, 0, 0) + b"".join(_variable(len(p)) for p in packets)
    return b"caff" + struct.pack(">HH", 1, 0) + _chunk(b"desc", form) + _chunk(b"kuki", cookie.pack()) + _chunk(b"pakt", table) + _chunk(b"data", bytes(4) + b"".join(packets))


def read_caf(raw: bytes) -> tuple[Cookie, list[bytes], int]:
    """Configuration, packets and valid frames; chunks that are not needed are skipped."""
    if raw[:4] != b"caff":
        raise ValueError("not CAF")
    at, found = 8, {}
    while at + 12 <= len(raw):
        name, size = struct.unpack_from(">4sq", raw, at)
        size = len(raw) - at - 12 if size == -1 and name == b"data" else size
        if size < 0 or at + 12 + size > len(raw):
            raise ValueError("a chunk runs past the end")
        found.setdefault(name, (at + 12, size))
        at += 12 + size
    if missing := {b"desc", b"kuki", b"pakt", b"data"} - found.keys():
        raise ValueError(f"no {', '.join(sorted(m.decode() for m in missing))} chunk")
    if raw[found[b"desc"][0] + 8 : found[b"desc"][0] + 12] != b"alac":
        raise ValueError("the format is not ALAC")
    start, size = found[b"kuki"]
    cookie = Cookie.unpack(raw[start : start + size])
    start, size = found[b"pakt"]
    count, frames = struct.unpack_from(">qq", raw, start)
    place, end = start + 24, start + size
    at, last = found[b"data"][0] + 4, sum(found[b"data"])
    packets = []
    for _ in range(count):
        n = 0
        while True:
            if place >= end:
                raise ValueError("the packet table ends early")
            b = raw[place]
            place, n = place + 1, n << 7 | b & 127
            if not b & 128:
                break
        if at + n > last:
            raise ValueError("a packet runs past the end")
        packets.append(raw[at : at + n])
        at += n
    return cookie, packets, frames


def encode(pcm: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A CAF file of samples (frames by channels)."""
    pcm = np.asarray(pcm)
    cookie = Cookie(PACKET_FRAMES, bits, pcm.shape[1], rate)
    Cookie.unpack(cookie.pack())
    return caf([encode_packet(pcm[a : a + PACKET_FRAMES], cookie) for a in range(0, len(pcm), PACKET_FRAMES)], cookie, len(pcm))


def decode(raw: bytes) -> tuple[Cookie, np.ndarray]:
    cookie, packets, frames = read_caf(raw)
    out = [decode_packet(p, cookie) for p in packets]
    return cookie, (np.concatenate(out) if out else np.zeros((0, cookie.channels), np.int32))[:frames]
