"""FLAC: a decoder for the whole format and a fixed-predictor encoder.

Frames are independent; each encoder block is coded on its own, so blocks of a
clip can be coded in any partition and joined in order.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from wavelattice.sources.bits import BitReader, flac_crc8, flac_crc16

# Fixed values of the format.
SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
RATES = (0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000)
DEPTHS = (0, 8, 12, 0, 16, 20, 24, 32)
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


@dataclass(frozen=True)
class Info:
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes


class _Stream(BitReader):
    """A bit reader over a long string that reads a window at a time."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.value, self.left = data, at, 0, 0

    def read(self, n: int) -> int:
        while self.left < n:
            part = self.data[self.at : self.at + 64]
            if not part:
                raise EOFError("no more bits")
            self.value = (self.value & ((1 << self.left) - 1)) << 8 * len(part) | int.from_bytes(part, "big")
            self.left += 8 * len(part)
            self.at += len(part)
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n

    @property
    def place(self) -> int:
        """The next whole byte."""
        return self.at - self.left // 8

    def align(self) -> None:
        self.left -= self.left % 8


def info(raw: bytes) -> tuple[Info, int]:
    """Stream information and the place of the first frame."""
    if raw[:4] != b"fLaC":
        raise ValueError("not FLAC")
    at, found = 4, None
    while True:
        last, kind, size = raw[at] >> 7, raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        if kind == 0:
            v = int.from_bytes(raw[at + 14 : at + 22], "big")
            found = Info(v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1, v & ((1 << 36) - 1), raw[at + 22 : at + 38])
        at += 4 + size
        if last:
            break
    if found is None:
        raise ValueError("no stream information")
    return found, at


def _residual(r: _Stream, size: int, order: int) -> list[int]:
    method, parts = r.read(2), 1 << r.read(4)
    width, escape = (4, 15) if method == 0 else (5, 31)
    out: list[int] = []
    for p in range(parts):
        n = size // parts - (order if p == 0 else 0)
        k = r.read(width)
        if k == escape:
            k = r.read(5)
            out += [r.signed(k) for _ in range(n)]
            continue
        for _ in range(n):
            v = r.zeros() << k | (r.read(k) if k else 0)
            out.append(v >> 1 ^ -(v & 1))
    return out


def _subframe(r: _Stream, size: int, bits: int) -> np.ndarray:
    r.read(1)
    kind = r.read(6)
    wasted = r.zeros() + 1 if r.read(1) else 0
    bits -= wasted
    if kind == 0:
        out = [r.signed(bits)] * size
    elif kind == 1:
        out = [r.signed(bits) for _ in range(size)]
    else:
        if 8 <= kind <= 12:
            order = kind - 8
            out = [r.signed(bits) for _ in range(order)]
            weights, shift = FIXED[order], 0
        elif kind >= 32:
            order = kind - 31
            out = [r.signed(bits) for _ in range(order)]
            precision, shift = r.read(4) + 1, r.signed(5)
            weights = [r.signed(precision) for _ in range(order)]
        else:
            raise ValueError("a reserved subframe type")
        for e in _residual(r, size, order):
            out.append(e + (sum(w * out[-1 - i] for i, w in enumerate(weights)) >> shift))
    return np.array(out, np.int64) << wasted


def decode(raw: bytes, check: bool = True) -> tuple[Info, np.ndarray]:
    """Information and samples (frames by channels); checksums and MD5 are verified."""
    head, at = info(raw)
    blocks = []
    while at + 2 <= len(raw) and raw[at] == 0xFF and raw[at + 1] >> 1 == 0x7C:
        r = _Stream(raw, at + 2)
        size_code, rate_code, layout, depth = r.read(4), r.read(4), r.read(4), r.read(3)
        r.read(1)
        lead = r.read(8)
        for _ in range(max(0, 7 - (lead ^ 0xFF).bit_length() if lead >= 0xC0 else 0)):
            r.read(8)
        size = r.read(8) + 1 if size_code == 6 else r.read(16) + 1 if size_code == 7 else SIZES[size_code]
        r.read({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        if flac_crc8(raw[at : r.place]) != r.read(8):
            raise ValueError("a frame header is damaged")
        bits = DEPTHS[depth] or head.bits
        side = {8: 1, 9: 0, 10: 1}.get(layout)
        n = 2 if layout >= 8 else layout + 1
        c = [_subframe(r, size, bits + (k == side)) for k in range(n)]
        if layout == 8:
            c[1] = c[0] - c[1]
        elif layout == 9:
            c[0] = c[0] + c[1]
        elif layout == 10:
            mid = c[0] << 1 | c[1] & 1
            c = [mid + c[1] >> 1, mid - c[1] >> 1]
        r.align()
        end = r.place
        if flac_crc16(raw[at:end]) != r.read(16):
            raise ValueError("a frame is damaged")
        blocks.append(np.stack(c, axis=1))
        at = end + 2
    pcm = np.concatenate(blocks) if blocks else np.zeros((0, head.channels), np.int64)
    if check and any(head.md5) and pcm_md5(pcm, head.bits) != head.md5:
        raise ValueError("the samples do not match their digest")
    return head, pcm


def pcm_md5(pcm: np.ndarray, bits: int) -> bytes:
    """Digest of the samples packed little-endian."""
    packed = np.ascontiguousarray(pcm, "<i4").view(np.uint8).reshape(-1, 4)[:, : (bits + 7) // 8]
    return hashlib.md5(packed.tobytes()).digest()


class _Writer:
    def __init__(self):
        self.parts: list[str] = []

    def put(self, v: int, n: int) -> None:
        if n:
            self.parts.append(format(v & ((1 << n) - 1), f"0{n}b"))

    def bytes(self) -> bytes:
        s = "".join(self.parts)
        s += "0" * (-len(s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big") if s else b""


def _utf8(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    rest = [0x80 | n >> 6 * i & 63 for i in range(size - 2, -1, -1)]
    return bytes([(0xFF00 >> size & 0xFF) | n >> 6 * (size - 1), *rest])


def _coded(x: np.ndarray, bits: int, w: _Writer) -> None:
    """One channel by the best fixed predictor and one Rice parameter."""
    if len(x) and (x == x[0]).all():
        w.put(0, 8)
        w.put(int(x[0]), bits)
        return
    best = None
    for order in range(min(4, len(x) - 1) + 1):
        e = np.diff(x, order)
        u = np.where(e < 0, -2 * e - 1, 2 * e)
        k = min(14, max(0, int(np.log2(max(u.mean(), 1)))))
        cost = int((u >> k).sum()) + len(u) * (k + 1) + order * bits
        if best is None or cost < best[0]:
            best = cost, order, k, u
    cost, order, k, u = best
    if cost >= len(x) * bits:
        w.put(2, 8)
        for v in x.tolist():
            w.put(v, bits)
        return
    w.put((8 + order) << 1, 8)
    for v in x[:order].tolist():
        w.put(v, bits)
    w.put(0, 6)
    w.put(k, 4)
    for v in u.tolist():
        w.parts.append("0" * (v >> k) + "1")
        w.put(v, k)


def encode_block(pcm: np.ndarray, bits: int, number: int) -> bytes:
    """One frame of samples (frames by channels)."""
    n, channels = pcm.shape
    head = b"\xff\xf8" + bytes([0x70, (channels - 1) << 4 | DEPTHS.index(bits) << 1]) + _utf8(number) + (n - 1).to_bytes(2, "big")
    w = _Writer()
    for c in range(channels):
        _coded(pcm[:, c].astype(np.int64), bits, w)
    out = head + bytes([flac_crc8(head)]) + w.bytes()
    return out + flac_crc16(out).to_bytes(2, "big")


def stream_header(rate: int, channels: int, bits: int, total: int, md5: bytes, block: int = 4096) -> bytes:
    v = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | total
    return b"fLaC\x80\0\0\x22" + block.to_bytes(2, "big") * 2 + bytes(6) + v.to_bytes(8, "big") + md5


def encode(pcm: np.ndarray, rate: int, bits: int, block: int = 4096) -> bytes:
    frames = [encode_block(pcm[a : a + block], bits, i) for i, a in enumerate(range(0, len(pcm), block))]
    return stream_header(rate, pcm.shape[1], bits, len(pcm), pcm_md5(pcm, bits), block) + b"".join(frames)
