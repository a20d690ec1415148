"""RTMP without sockets: handshake bytes, control, command and data messages over the chunk stream."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from wavelattice.sources.containers import amf0_read, amf0_write
from wavelattice.sources.muxers import rtmp_chunks, rtmp_messages

HANDSHAKE = 1536
# Message types.
SET_CHUNK, ABORT, ACKNOWLEDGE, USER, WINDOW, BANDWIDTH, AUDIO, VIDEO, DATA, COMMAND = 1, 2, 3, 4, 5, 6, 8, 9, 18, 20


def hello(time: int, noise: bytes) -> bytes:
    """The first two parts that a side sends."""
    if len(noise) != HANDSHAKE - 8:
        raise ValueError(f"{HANDSHAKE - 8} bytes of noise are needed")
    return b"\x03" + struct.pack(">II", time, 0) + noise


def answer(theirs: bytes, time: int) -> bytes:
    """The third part: the other side's first ones, with the time at which they came."""
    if len(theirs) != HANDSHAKE + 1 or theirs[0] != 3:
        raise ValueError("not a handshake of version 3")
    return theirs[1:5] + struct.pack(">I", time) + theirs[9:]


def answered(mine: bytes, reply: bytes) -> bool:
    """Whether a reply repeats what was sent."""
    return len(reply) == HANDSHAKE and reply[:4] == mine[1:5] and reply[8:] == mine[9:]


def control(kind: int, *values: int) -> bytes:
    """The payload of a control message: chunk size, acknowledgement, window, or bandwidth with its limit type."""
    if kind == BANDWIDTH:
        return struct.pack(">IB", *values)
    return struct.pack(f">{len(values)}I", *values)


def user_event(event: int, *values: int) -> bytes:
    return struct.pack(f">H{len(values)}I", event, *values)


def values(payload: bytes) -> list[object]:
    """All AMF0 values of a command or data message."""
    out, at = [], 0
    while at < len(payload):
        v, at = amf0_read(payload, at)
        out.append(v)
    return out


def command(name: str, transaction: float, *arguments: object) -> bytes:
    return b"".join(map(amf0_write, (name, float(transaction), *arguments)))


def session(messages: list[tuple[int, int, int, bytes]], chunk: int = 128) -> bytes:
    """Messages (type, stream, time, payload) as chunks; a larger chunk size is announced first."""
    out = b""
    if chunk != 128:
        out = rtmp_chunks([(SET_CHUNK, 0, 0, control(SET_CHUNK, chunk))], channel=2)
    return out + rtmp_chunks(messages, chunk)


def events(raw: bytes) -> Iterator[tuple[str, int, object]]:
    """(kind, time, content) of a received chunk stream, as a server reads it: commands, metadata, media tags and control."""
    for kind, _, time, payload in rtmp_messages(raw):
        if kind == COMMAND:
            yield "command", time, values(payload)
        elif kind == DATA:
            yield "data", time, values(payload)
        elif kind in (AUDIO, VIDEO):
            yield "audio" if kind == AUDIO else "video", time, payload
        elif kind in (SET_CHUNK, ACKNOWLEDGE, WINDOW):
            yield "control", time, (kind, struct.unpack_from(">I", payload)[0])


def publish(app: str, stream: str, tags: list[tuple[int, int, bytes]], metadata: dict | None = None, chunk: int = 4096) -> bytes:
    """What a publisher sends after the handshake: connect, create, publish, metadata and tags (type, time, body)."""
    messages = [
        (COMMAND, 0, 0, command("connect", 1, {"app": app, "type": "nonprivate"})),
        (COMMAND, 0, 0, command("createStream", 2, None)),
        (COMMAND, 1, 0, command("publish", 3, None, stream, "live")),
    ]
    if metadata is not None:
        messages.append((DATA, 1, 0, amf0_write("@setDataFrame") + amf0_write("onMetaData") + amf0_write(metadata)))
    return session(messages + [(kind, 1, time, body) for kind, time, body in tags], chunk)
