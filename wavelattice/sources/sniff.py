"""Media types by magic bytes, and tag readers."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset, bytes in hexadecimal and extension, in the order of the tests.
MAGIC = (
    (0, "52494646", 8, "57415645", "wav"),
    (0, "52494646", 8, "41564920", "avi"),
    (0, "464F524D", 8, "41494646", "aiff"),
    (0, "464F524D", 8, "41494643", "aiff"),
    (0, "2E736E64", 0, "", "au"),
    (0, "664C6143", 0, "", "flac"),
    (0, "63616666", 0, "", "caf"),
    (0, "54544131", 0, "", "tta"),
    (0, "7776706B", 0, "", "wv"),
    (0, "464C5601", 0, "", "flv"),
    (0, "1A45DFA3", 0, "", "mkv"),
    (0, "3026B275", 0, "", "wma"),
    (4, "66747970", 0, "", "mp4"),
    (0, "4F676753", 28, "4F707573", "opus"),
    (0, "4F676753", 0, "", "ogg"),
    (0, "494433", 0, "", "mp3"),
)


def extension(content: Column) -> Column:
    """The extension that the first bytes of a file stand for; null if none."""
    head = F.hex(F.substring(content, 1, 64))
    out = None
    for at, first, then, second, name in MAGIC:
        test = F.substring(head, 2 * at + 1, len(first)) == first
        if second:
            test = test & (F.substring(head, 2 * then + 1, len(second)) == second)
        out = F.when(test, name) if out is None else out.when(test, name)
    sync = F.substring(head, 1, 3) == "FFF"
    layer = F.conv(F.substring(head, 4, 1), 16, 10).cast("int").bitwiseAND(F.lit(6))
    return out.when(sync & (layer == 0), "aac").when(sync | (F.substring(head, 1, 3) == "FFE"), "mp3")


def vorbis_comments(raw: bytes, at: int = 0) -> dict[str, str]:
    """Length-prefixed KEY=value entries; a broken tail keeps those before it, the last of a key counts."""
    out: dict[str, str] = {}
    try:
        at += 4 + struct.unpack_from("<I", raw, at)[0]
        (n,) = struct.unpack_from("<I", raw, at)
        at += 4
        for _ in range(n):
            (size,) = struct.unpack_from("<I", raw, at)
            if at + 4 + size > len(raw):
                break
            key, eq, value = raw[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
            if eq:
                out[key.upper()] = value
            at += 4 + size
    except struct.error:
        pass
    return out


def vorbis_bytes(tags: dict[str, str], vendor: str = "") -> bytes:
    def sized(s: str) -> bytes:
        return struct.pack("<I", len(s.encode())) + s.encode()

    for key in tags:
        if not key or "=" in key or not all(" " <= c <= "}" for c in key):
            raise ValueError(f"{key!r} can't be a key")
    return sized(vendor) + struct.pack("<I", len(tags)) + b"".join(sized(f"{k}={v}") for k, v in tags.items())


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3v2(raw: bytes) -> dict[str, str]:
    """Text frames of an ID3v2.3 or 2.4 tag; user-defined ones are skipped."""
    if raw[:3] != b"ID3" or len(raw) < 10 or raw[3] not in (3, 4):
        return {}
    end, at, out = min(len(raw), 10 + _synchsafe(raw[6:10])), 10, {}
    while at + 10 <= end and raw[at : at + 1].isalnum():
        name = raw[at : at + 4].decode("latin-1")
        size = _synchsafe(raw[at + 4 : at + 8]) if raw[3] == 4 else int.from_bytes(raw[at + 4 : at + 8], "big")
        body = raw[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and name != "TXXX" and body:
            coding = ("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3]
            out[name] = body[1:].decode(coding, "replace").split("\0")[0]
        at += 10 + size
    return out


def id3v2_bytes(tags: dict[str, str]) -> bytes:
    """An ID3v2.4 tag of UTF-8 text frames."""
    size = lambda n: bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))
    frames = b"".join(k.encode("latin-1") + size(len(v.encode()) + 1) + b"\0\0\x03" + v.encode() for k, v in tags.items())
    return b"ID3\x04\0\0" + size(len(frames)) + frames
