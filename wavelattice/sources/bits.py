"""Bit-level parsing: readers, NAL framing, codec configuration records and frame headers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass


class BitReader:
    """Reads a byte string from its highest bit on; reading past the end raises EOFError."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int) -> int:
        if n > self.left:
            raise EOFError("no more bits")
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def unsigned_golomb(self) -> int:
        zeros = 0
        while not self.read(1):
            zeros += 1
            if zeros > 32:
                raise ValueError("an Exp-Golomb code is too long")
        return (1 << zeros) - 1 + (self.read(zeros) if zeros else 0)

    def signed_golomb(self) -> int:
        k = self.unsigned_golomb()
        return (k + 1) // 2 if k & 1 else -(k // 2)


def without_emulation(nal: bytes) -> bytes:
    """The payload without the 3 of each 00 00 03."""
    out, zeros = bytearray(), 0
    for b in nal:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def nal_units(annex_b: bytes) -> list[bytes]:
    """Units between start codes; zeros before a start code belong to it."""
    out, at = [], annex_b.find(b"\0\0\1")
    while at >= 0:
        end = annex_b.find(b"\0\0\1", at + 3)
        unit = annex_b[at + 3 : end if end >= 0 else len(annex_b)]
        unit = unit.rstrip(b"\0") if end >= 0 else unit
        if unit:
            out.append(unit)
        at = end
    return out


def to_length_prefixed(annex_b: bytes, size: int = 4) -> bytes:
    return b"".join(len(u).to_bytes(size, "big") + u for u in nal_units(annex_b))


def to_annex_b(prefixed: bytes, size: int = 4) -> bytes:
    out, at = b"", 0
    while at < len(prefixed):
        n = int.from_bytes(prefixed[at : at + size], "big")
        if at + size + n > len(prefixed):
            raise ValueError("a unit runs past the end")
        out += b"\0\0\0\1" + prefixed[at + size : at + size + n]
        at += size + n
    return out


@dataclass(frozen=True)
class AvcConfig:
    profile: int
    compatibility: int
    level: int
    length_size: int
    sps: tuple[bytes, ...]
    pps: tuple[bytes, ...]


def parse_avcc(record: bytes) -> AvcConfig:
    if len(record) < 7 or record[0] != 1:
        raise ValueError("not an AVC configuration record")
    at, sets = 6, []
    counts = [record[5] & 31, None]
    for k in range(2):
        if k:
            counts[1] = record[at]
            at += 1
        own = []
        for _ in range(counts[k]):
            n = int.from_bytes(record[at : at + 2], "big")
            if at + 2 + n > len(record):
                raise ValueError("a parameter set runs past the end")
            own.append(record[at + 2 : at + 2 + n])
            at += 2 + n
        sets.append(tuple(own))
    return AvcConfig(record[1], record[2], record[3], (record[4] & 3) + 1, *sets)


def build_avcc(c: AvcConfig) -> bytes:
    sized = lambda units: b"".join(len(u).to_bytes(2, "big") + u for u in units)
    return bytes([1, c.profile, c.compatibility, c.level, 0xFC | c.length_size - 1, 0xE0 | len(c.sps)]) + sized(c.sps) + bytes([len(c.pps)]) + sized(c.pps)


# Profiles whose parameter set carries the chroma format.
HIGH_PROFILES = (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135)


def parse_h264_sps(nal: bytes) -> dict[str, int]:
    """Profile, level and cropped size of a sequence parameter set."""
    r = BitReader(without_emulation(nal[1:]))
    profile, _, level = r.read(8), r.read(8), r.read(8)
    r.unsigned_golomb()
    chroma = 1
    if profile in HIGH_PROFILES:
        chroma = r.unsigned_golomb()
        if chroma == 3:
            r.read(1)
        r.unsigned_golomb(), r.unsigned_golomb(), r.read(1)
        if r.read(1):
            for k in range(12 if chroma == 3 else 8):
                if r.read(1):
                    last = now = 8
                    for _ in range(16 if k < 6 else 64):
                        now = (last + r.signed_golomb()) % 256 if now else now
                        last = now or last
    r.unsigned_golomb()
    order = r.unsigned_golomb()
    if order == 0:
        r.unsigned_golomb()
    elif order == 1:
        r.read(1), r.signed_golomb(), r.signed_golomb()
        for _ in range(r.unsigned_golomb()):
            r.signed_golomb()
    r.unsigned_golomb(), r.read(1)
    width, rows = (r.unsigned_golomb() + 1) * 16, r.unsigned_golomb() + 1
    frames = r.read(1)
    height = rows * 16 * (2 - frames)
    if not frames:
        r.read(1)
    r.read(1)
    if r.read(1):
        x, y = (2 if chroma in (1, 2) else 1), (2 if chroma == 1 else 1) * (2 - frames)
        left, right, top, bottom = (r.unsigned_golomb() for _ in range(4))
        width, height = width - x * (left + right), height - y * (top + bottom)
    return {"profile": profile, "level": level, "width": width, "height": height}


# Sample rates by index.
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def adts_header(object_type: int, rate: int, channels: int, payload: int) -> bytes:
    """The 7-byte header before a raw frame."""
    size = payload + 7
    bits = 0xFFF << 44 | 1 << 40 | (object_type - 1) << 38 | ADTS_RATES.index(rate) << 34 | channels << 30 | size << 13 | 0x7FF << 2
    return bits.to_bytes(7, "big")


def adts_frames(raw: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(object type, rate, channels, payload) of each whole frame."""
    at = 0
    while at + 7 <= len(raw):
        bits = int.from_bytes(raw[at : at + 7], "big")
        size = bits >> 13 & 0x1FFF
        if bits >> 44 != 0xFFF or size < 7 or at + size > len(raw):
            return
        skip = 7 if bits >> 40 & 1 else 9
        yield (bits >> 38 & 3) + 1, ADTS_RATES[bits >> 34 & 15], bits >> 30 & 7, raw[at + skip : at + size]
        at += size


def crc(data: bytes, polynomial: int, width: int, start: int = 0) -> int:
    """A checksum whose register shifts left, as Ogg (32 bits), MPEG-TS and FLAC (8 and 16 bits) use it."""
    table, top = _crc_table(polynomial, width), width - 8
    full = (1 << width) - 1
    for b in data:
        start = (start << 8 & full) ^ table[start >> top ^ b]
    return start


_tables: dict[tuple[int, int], list[int]] = {}


def _crc_table(polynomial: int, width: int) -> list[int]:
    if (polynomial, width) not in _tables:
        full, high, out = (1 << width) - 1, 1 << (width - 1), []
        for k in range(256):
            v = k << (width - 8)
            for _ in range(8):
                v = (v << 1 ^ polynomial if v & high else v << 1) & full
            out.append(v)
        _tables[polynomial, width] = out
    return _tables[polynomial, width]


_MIRROR = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def _mirrored_crc32(data: bytes, start: int) -> int:
    """crc() of 32 bits under 0x04C11DB7 from 0 or all ones: zlib's checksum has the same polynomial with all bits the other way round."""
    out = zlib.crc32(data.translate(_MIRROR), start ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(out.to_bytes(4, "little").translate(_MIRROR), "big")


def ogg_crc(data: bytes) -> int:
    return _mirrored_crc32(data, 0)


def ts_crc(data: bytes) -> int:
    return _mirrored_crc32(data, 0xFFFFFFFF)


def flac_crc8(data: bytes) -> int:
    return crc(data, 0x07, 8)


def flac_crc16(data: bytes) -> int:
    return crc(data, 0x8005, 16)
