"""ASF containers: header objects and data packets, read and written."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

# Object and stream identifiers.
HEADER, DATA, FILE, STREAM, AUDIO = (
    uuid.UUID(x).bytes_le
    for x in (
        "75b22630-668e-11cf-a6d9-00aa0062ce6c", "75b22636-668e-11cf-a6d9-00aa0062ce6c", "8cabdca1-a947-11cf-8ee4-00c00c205365",
        "b7dc0791-a9b7-11cf-8ee6-00c00c205365", "f8699e40-5b4d-11cf-a8fd-00805f5c442b",
    )
)


def objects(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(identifier, start, end) of the objects of a range."""
    while at + 24 <= end:
        size = struct.unpack_from("<Q", raw, at + 16)[0]
        if size < 24 or at + size > end:
            raise ValueError("an object runs past the end")
        yield raw[at : at + 16], at + 24, at + size
        at += size


def read(raw: bytes) -> tuple[dict, list[tuple[int, int, bytes]]]:
    """What the header says of the audio stream, and the media objects (stream, time in ms, data) in order."""
    if raw[:16] != HEADER:
        raise ValueError("not ASF")
    head, packet, out = {}, 0, []
    for kind, a, b in objects(raw, 0, len(raw)):
        if kind == HEADER:
            for sub, c, d in objects(raw, a + 6, b):
                if sub == FILE:
                    head["duration_ms"] = struct.unpack_from("<Q", raw, c + 40)[0] // 10_000
                    packet = struct.unpack_from("<I", raw, c + 68)[0]
                elif sub == STREAM and raw[c : c + 16] == AUDIO:
                    size = struct.unpack_from("<I", raw, c + 40)[0]
                    tag, channels, rate, speed, align, bits = struct.unpack_from("<HHIIHH", raw, c + 54)
                    head |= {"stream": struct.unpack_from("<H", raw, c + 48)[0] & 127, "tag": tag, "channels": channels, "rate": rate, "align": align, "extra": raw[c + 72 : c + 54 + size]}
        elif kind == DATA:
            count = struct.unpack_from("<Q", raw, a + 16)[0]
            at, parts = a + 26, {}
            for _ in range(count):
                if at >= b:
                    break
                out += _payloads(raw, at, min(b, at + packet) if packet else b, parts)
                at += packet or b
    if "stream" not in head:
        raise ValueError("no audio stream")
    return head, [(s, t, d) for s, t, d in out if s == head["stream"]]


def _field(raw: bytes, at: int, kind: int) -> tuple[int, int]:
    size = (0, 1, 2, 4)[kind]
    return int.from_bytes(raw[at : at + size], "little"), at + size


def _payloads(raw: bytes, at: int, end: int, parts: dict) -> list[tuple[int, int, bytes]]:
    """The media objects that end in one data packet; pieces wait in ``parts``."""
    if raw[at] & 0x80:
        at += 1 + (raw[at] & 15)
    flags, shape, at = raw[at], raw[at + 1], at + 2
    _, at = _field(raw, at, flags >> 5 & 3)
    _, at = _field(raw, at, flags >> 1 & 3)
    padding, at = _field(raw, at, flags >> 3 & 3)
    at += 6  # send time and duration
    count, sized = 1, 0
    if flags & 1:
        count, sized, at = raw[at] & 63, raw[at] >> 6, at + 1
    end -= padding
    done = []
    for _ in range(count):
        stream, at = raw[at] & 127, at + 1
        number, at = _field(raw, at, shape >> 4 & 3)
        offset, at = _field(raw, at, shape >> 2 & 3)
        extra, at = _field(raw, at, shape & 3)
        if extra == 1:
            time, at, pieces = offset, at + 1, []
            size, at = _field(raw, at, sized) if flags & 1 else (end - at, at)
            stop = at + size
            while at < stop:
                n = raw[at]
                pieces.append(raw[at + 1 : at + 1 + n])
                at += 1 + n
            done += [(stream, time, p) for p in pieces]
            continue
        whole, time = struct.unpack_from("<II", raw, at) if extra >= 8 else (0, 0)
        at += extra
        size, at = _field(raw, at, sized) if flags & 1 else (end - at, at)
        held = parts.setdefault((stream, number), bytearray())
        held += raw[at : at + size]
        at += size
        if len(held) >= whole:
            done.append((stream, time, bytes(parts.pop((stream, number)))))
    return done


def write(channels: int, rate: int, tag: int, align: int, extra: bytes, frames: list[tuple[int, bytes]], packet: int = 3200) -> bytes:
    """A file of one audio stream from (time in ms, data); data longer than a packet is cut over several."""
    form = struct.pack("<HHIIHHH", tag, channels, rate, rate * 2, align, 16, len(extra)) + extra
    stream = AUDIO + bytes(16) + struct.pack("<QIIHI", 0, len(form), 0, 1, 0) + form
    room, packets = packet - 2 - 2 - 6 - 1 - 1 - 4 - 1 - 8, []
    for number, (time, data) in enumerate(frames):
        for at in range(0, max(len(data), 1), room):
            part = data[at : at + room]
            body = struct.pack("<IH", time, 0) + bytes([1, number & 255]) + struct.pack("<I", at) + bytes([8]) + struct.pack("<II", len(data), time) + part
            padding = packet - 4 - len(body)
            packets.append(bytes([0x10, 0x5D]) + struct.pack("<H", padding) + body + bytes(padding))
    last = frames[-1][0] if frames else 0
    properties = bytes(16) + struct.pack("<QQQQQQIIII", 0, 0, len(packets), last * 10_000, last * 10_000, 0, 2, packet, packet, rate * 2)
    listed = b"".join(k + struct.pack("<Q", len(b) + 24) + b for k, b in ((FILE, properties), (STREAM, stream)))
    head = HEADER + struct.pack("<QIBB", len(listed) + 30, 2, 1, 2) + listed
    body = bytes(16) + struct.pack("<QBB", len(packets), 1, 1) + b"".join(packets)
    return head + DATA + struct.pack("<Q", len(body) + 24) + body
