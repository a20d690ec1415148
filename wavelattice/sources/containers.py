"""Containers as tables of packets: FLV, Ogg, MP4, fragmented MP4, Matroska and AVI files read through Spark.

``packets(files)`` takes rows of format binaryFile and gives one row a packet:
source_id, track_id, codec, timescale, pts, dts, is_keyframe, config_version,
payload. Files are independent; the memory of a task is that of a file.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wavelattice.operators.packets import decode_times
from wavelattice.sources import bits

SCHEMA = "source_id string, track_id int, codec string, timescale int, pts long, dts long, is_keyframe boolean, config_version int, payload binary"


# AMF0: a value is a number, boolean, string, dict, list or None; objects may nest up to a depth.
def amf0_read(raw: bytes, at: int = 0, depth: int = 32) -> tuple[object, int]:
    """The value at a place, and the place behind it."""
    if depth < 0:
        raise ValueError("values nest too deeply")
    kind, at = raw[at], at + 1
    if kind == 0:
        return struct.unpack_from(">d", raw, at)[0], at + 8
    if kind == 1:
        return bool(raw[at]), at + 1
    if kind in (2, 12, 15):
        size = 2 if kind == 2 else 4
        n = int.from_bytes(raw[at : at + size], "big")
        if at + size + n > len(raw):
            raise ValueError("a string runs past the end")
        return raw[at + size : at + size + n].decode("utf-8", "replace"), at + size + n
    if kind in (3, 8):
        at += 4 if kind == 8 else 0
        out = {}
        while raw[at : at + 3] != b"\0\0\x09":
            if at + 2 > len(raw):
                raise ValueError("an object has no end")
            n = int.from_bytes(raw[at : at + 2], "big")
            key = raw[at + 2 : at + 2 + n].decode("utf-8", "replace")
            out[key], at = amf0_read(raw, at + 2 + n, depth - 1)
        return out, at + 3
    if kind in (5, 6):
        return None, at
    if kind == 10:
        n, at, items = int.from_bytes(raw[at : at + 4], "big"), at + 4, []
        for _ in range(n):
            v, at = amf0_read(raw, at, depth - 1)
            items.append(v)
        return items, at
    if kind == 11:
        return struct.unpack_from(">d", raw, at)[0], at + 10
    raise ValueError(f"type {kind} is not known")


def amf0_write(v: object) -> bytes:
    if isinstance(v, bool):
        return bytes([1, v])
    if isinstance(v, (int, float)):
        return b"\0" + struct.pack(">d", v)
    if isinstance(v, str):
        b = v.encode()
        return b"\x02" + struct.pack(">H", len(b)) + b if len(b) < 1 << 16 else b"\x0c" + struct.pack(">I", len(b)) + b
    if isinstance(v, dict):
        return b"\x03" + b"".join(struct.pack(">H", len(k.encode())) + k.encode() + amf0_write(x) for k, x in v.items()) + b"\0\0\x09"
    if isinstance(v, (list, tuple)):
        return b"\x0a" + struct.pack(">I", len(v)) + b"".join(map(amf0_write, v))
    if v is None:
        return b"\x05"
    raise TypeError(f"{type(v)} has no AMF0 form")


# FLV
def flv_tags(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(type, unwrapped time in ms, body) of every whole tag."""
    if raw[:3] != b"FLV":
        raise ValueError("not FLV")
    at, time, last = int.from_bytes(raw[5:9], "big") + 4, None, 0
    while at + 11 <= len(raw):
        size = int.from_bytes(raw[at + 1 : at + 4], "big")
        stamp = int.from_bytes(raw[at + 4 : at + 7], "big") | raw[at + 7] << 24
        if at + 11 + size > len(raw):
            return
        time = stamp if time is None else time + ((stamp - last + (1 << 31)) % (1 << 32) - (1 << 31))
        last = stamp
        yield raw[at] & 31, time, raw[at + 11 : at + 11 + size]
        at += 15 + size


def flv_packets(raw: bytes) -> Iterator[tuple]:
    """Video is track 0, audio track 1; a changed codec configuration raises the version."""
    version, config = {8: 0, 9: 0}, {}
    audio = {2: "mp3", 10: "aac"}
    for kind, time, body in flv_tags(raw):
        if not body:
            continue
        if kind == 9 and body[0] & 15 == 7 and len(body) >= 5:
            offset = int.from_bytes(body[2:5], "big")
            offset -= (offset & 1 << 23) << 1
            if body[1] == 0:
                version[9] += config.get(9) not in (None, body[5:])
                config[9] = body[5:]
            elif body[1] == 1:
                yield 0, "h264", 1000, time + offset, time, body[0] >> 4 == 1, version[9], body[5:]
        elif kind == 8 and body[0] >> 4 in audio:
            if body[0] >> 4 == 10:
                if len(body) >= 2 and body[1] == 0:
                    version[8] += config.get(8) not in (None, body[2:])
                    config[8] = body[2:]
                elif len(body) >= 2:
                    yield 1, "aac", 1000, time, time, True, version[8], body[2:]
            else:
                yield 1, "mp3", 1000, time, time, True, 0, body[1:]


def flv_file(tags: list[tuple[int, int, bytes]]) -> bytes:
    """An FLV file of (type, time in ms, body) tags."""
    out = b"FLV\x01\x05" + struct.pack(">I", 9) + bytes(4)
    for kind, time, body in tags:
        t = time & 0xFFFFFFFF
        head = bytes([kind]) + len(body).to_bytes(3, "big") + (t & 0xFFFFFF).to_bytes(3, "big") + bytes([t >> 24]) + bytes(3)
        out += head + body + struct.pack(">I", 11 + len(body))
    return out


# Ogg
def ogg_packets(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(stream serial, granule position of the page it ends on, packet); pages with a bad checksum are left out."""
    open_: dict[int, bytes] = {}
    at = raw.find(b"OggS")
    while 0 <= at and at + 27 <= len(raw):
        granule, serial, _, check, n = struct.unpack_from("<qIIIB", raw, at + 6)
        sizes = raw[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(sizes)
        if end > len(raw):
            return
        if bits.ogg_crc(raw[at : at + 22] + bytes(4) + raw[at + 26 : end]) == check:
            if not raw[at + 5] & 1:
                open_.pop(serial, None)
            for size in sizes:
                open_[serial] = open_.get(serial, b"") + raw[start : start + size]
                start += size
                if size < 255:
                    yield serial, granule, open_.pop(serial)
        at = raw.find(b"OggS", end)


def ogg_page(serial: int, sequence: int, granule: int, packets_: list[bytes], first: bool = False) -> bytes:
    """One page of whole packets."""
    sizes = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets_)
    if len(sizes) > 255:
        raise ValueError("the packets do not fit into a page")
    head = b"OggS\0" + bytes([2 if first else 0]) + struct.pack("<qII", granule, serial, sequence)
    body = bytes([len(sizes)]) + sizes + b"".join(packets_)
    return head + struct.pack("<I", bits.ogg_crc(head + bytes(4) + body)) + body


# MP4
def boxes(raw: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes of a range; broken sizes end it."""
    end = len(raw) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", raw, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", raw, start + 8)[0], 16
        size = end - start if size == 0 else size
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def find_box(raw: bytes, path: str, start: int = 0, end: int | None = None) -> tuple[int, int] | None:
    kind, _, rest = path.partition("/")
    for k, a, b in boxes(raw, start, end):
        if k == kind.encode():
            return find_box(raw, rest, a, b) if rest else (a, b)
    return None


def _table(raw: bytes, span: tuple[int, int] | None, row: str) -> list[tuple]:
    if span is None:
        return []
    n, size = struct.unpack_from(">I", raw, span[0] + 4)[0], struct.calcsize(row)
    n = min(n, (span[1] - span[0] - 8) // size)
    return [struct.unpack_from(row, raw, span[0] + 8 + size * i) for i in range(n)]


def edit_shift(edits: list[tuple], movie_scale: int, timescale: int) -> int:
    """What an edit list takes from a track's times: the start of its first media edit, less the empty edits before it."""
    empty = 0
    for length, start, _ in edits:
        if start >= 0:
            return start - (empty * timescale // movie_scale if movie_scale else 0)
        empty += length
    return 0


def mp4_tracks(raw: bytes) -> list[dict]:
    """Each track's codec, timescale, sample offsets, sizes, times and sync samples."""
    out, moov = [], find_box(raw, "moov")
    mvhd = find_box(raw, "moov/mvhd")
    movie = struct.unpack_from(">I", raw, mvhd[0] + (20 if raw[mvhd[0]] == 1 else 12))[0] if mvhd else 0
    for kind, a, b in boxes(raw, *(moov or (0, 0))):
        if kind != b"trak":
            continue
        mdhd, stbl = find_box(raw, "mdia/mdhd", a, b), find_box(raw, "mdia/minf/stbl", a, b)
        if mdhd is None or stbl is None:
            continue
        timescale = struct.unpack_from(">I", raw, mdhd[0] + (20 if raw[mdhd[0]] == 1 else 12))[0]
        part = lambda name, s=stbl: find_box(raw, name, *s)
        stsd, stsz = part("stsd"), part("stsz")
        fixed, n = struct.unpack_from(">II", raw, stsz[0] + 4)
        sizes = [fixed] * n if fixed else [x[0] for x in struct.iter_unpack(">I", raw[stsz[0] + 12 : stsz[0] + 12 + 4 * n])]
        chunks = [x[0] for x in (_table(raw, part("stco"), ">I") or _table(raw, part("co64"), ">Q"))]
        runs = _table(raw, part("stsc"), ">III")
        offsets, k, run = [], 0, -1
        for c, at in enumerate(chunks, 1):
            while run + 1 < len(runs) and runs[run + 1][0] <= c:
                run += 1
            for _ in range(runs[run][1] if run >= 0 else 0):
                if k < len(sizes):
                    offsets.append(at)
                    at += sizes[k]
                    k += 1
        dts = [0]
        for count, delta in _table(raw, part("stts"), ">II"):
            for _ in range(count):
                dts.append(dts[-1] + delta)
        shift = [o for count, o in _table(raw, part("ctts"), ">Ii") for _ in range(count)] or [0] * len(sizes)
        sync = {x[0] for x in _table(raw, part("stss"), ">I")} if part("stss") else None
        edits = find_box(raw, "edts/elst", a, b)
        media = edit_shift(_table(raw, edits, ">QqI" if edits and raw[edits[0]] == 1 else ">IiI"), movie, timescale)
        codec = raw[stsd[0] + 12 : stsd[0] + 16].decode("latin-1") if stsd else ""
        out.append({"codec": codec, "timescale": timescale, "offsets": offsets, "sizes": sizes, "dts": dts[:-1], "end": dts[-1], "shift": shift, "sync": sync, "start": media})
    return out


def mp4_probe(raw: bytes) -> dict:
    """Duration, picture size, codec, frames, frame rate, rotation, and whether there is audio."""
    moov = find_box(raw, "moov")
    mvhd = moov and find_box(raw, "mvhd", *moov)
    if not mvhd:
        raise ValueError("no movie header")
    long = raw[mvhd[0]] == 1
    scale, duration = struct.unpack_from(">IQ" if long else ">II", raw, mvhd[0] + (20 if long else 12))
    out = {"duration_s": duration / scale if scale else 0.0, "width": None, "height": None, "codec": None, "frames": None, "frame_rate": None, "rotation": None, "has_audio": False}
    tracks = iter(mp4_tracks(raw))
    for kind, a, b in boxes(raw, *moov):
        if kind != b"trak" or not find_box(raw, "mdia/minf/stbl", a, b) or not find_box(raw, "mdia/mdhd", a, b):
            continue
        track, tkhd, hdlr = next(tracks), find_box(raw, "tkhd", a, b), find_box(raw, "mdia/hdlr", a, b)
        handler = raw[hdlr[0] + 8 : hdlr[0] + 12] if hdlr else b""
        out["has_audio"] |= handler == b"soun"
        if tkhd and tkhd[1] - tkhd[0] >= 84:
            at = tkhd[0] + (88 if raw[tkhd[0]] == 1 else 76)
            width, height = (v >> 16 for v in struct.unpack_from(">ii", raw, at))
            if width > 0 and height > 0 and out["width"] is None:
                out |= {"width": width, "height": height, "codec": track["codec"]}
            if handler == b"vide" and out["frames"] is None:
                c, s = struct.unpack_from(">ii", raw, at - 36)
                total = track["end"]
                out |= {"frames": len(track["sizes"]), "frame_rate": len(track["sizes"]) * track["timescale"] / total if total else None}
                out["rotation"] = {(1, 0): 0, (0, 1): 90, (-1, 0): 180, (0, -1): 270}.get((c >> 16, s >> 16))
    return out


def mp4_packets(raw: bytes) -> Iterator[tuple]:
    names = {"avc1": "h264", "avc3": "h264", "mp4a": "aac", "hvc1": "h265", "hev1": "h265", "Opus": "opus"}
    for t, x in enumerate(mp4_tracks(raw)):
        for k, (at, size, dts, shift) in enumerate(zip(x["offsets"], x["sizes"], x["dts"], x["shift"], strict=False)):
            key = x["sync"] is None or k + 1 in x["sync"]
            yield t, names.get(x["codec"], x["codec"]), x["timescale"], dts + shift - x["start"], dts - x["start"], key, 0, raw[at : at + size]


# Matroska
def element_id(raw: bytes, at: int) -> tuple[int, int]:
    n = 9 - raw[at].bit_length()
    return int.from_bytes(raw[at : at + n], "big"), at + n


def element_size(raw: bytes, at: int) -> tuple[int | None, int]:
    """A size (None if unknown) and the place behind it."""
    n = 9 - raw[at].bit_length()
    if n > 8:
        raise ValueError("a size is too long")
    v = int.from_bytes(raw[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if v == (1 << 7 * n) - 1 else v), at + n


def lacing(block: bytes, at: int, kind: int) -> list[bytes]:
    """The frames of a block from ``at``: 0 none, 1 Xiph, 2 fixed, 3 EBML lacing."""
    if kind == 0:
        return [block[at:]]
    n, at = block[at] + 1, at + 1
    if kind == 2:
        size, rest = divmod(len(block) - at, n)
        if rest:
            raise ValueError("the frames are not of one size")
        return [block[at + size * i : at + size * (i + 1)] for i in range(n)]
    sizes = []
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while block[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + block[at], at + 1
        else:
            v, end = element_size(block, at)
            size = v if i == 0 else sizes[-1] + v - ((1 << 7 * (end - at) - 1) - 1)
            at = end
        sizes.append(size)
    if sum(sizes) > len(block) - at or min(sizes, default=0) < 0:
        raise ValueError("the frames run past the end")
    out = []
    for size in sizes:
        out.append(block[at : at + size])
        at += size
    return [*out, block[at:]]


# Element ids.
_MASTER = {0x18538067, 0x1F43B675, 0x1654AE6B, 0xAE, 0xA0, 0x1549A966}
_CODECS = {"V_MPEG4/ISO/AVC": "h264", "A_AAC": "aac", "A_OPUS": "opus", "A_MPEG/L3": "mp3", "V_VP9": "vp9", "V_AV1": "av1", "V_MPEGH/ISO/HEVC": "h265"}


_REORDERED = ("h264", "h265")


def matroska_packets(raw: bytes) -> Iterator[tuple]:
    """Blocks in file order; the file has presentation times only, decode times of reordered video are rebuilt."""
    rows = list(_matroska_blocks(raw))
    times: dict[int, list[int]] = {}
    for track, codec, _, pts, *_ in rows:
        if codec in _REORDERED:
            times.setdefault(track, []).append(pts)
    decode = {track: iter(decode_times(pts)) for track, pts in times.items()}
    for row in rows:
        yield (*row[:4], next(decode[row[0]]), *row[5:]) if row[0] in decode else row


def _matroska_blocks(raw: bytes) -> Iterator[tuple]:
    at, scale, cluster, tracks, number, group = 0, 1_000_000, 0, {}, 0, None
    while at < len(raw):
        try:
            kind, body = element_id(raw, at)
            size, body = element_size(raw, body)
        except (IndexError, ValueError):
            break
        end = len(raw) if size is None else body + size
        if kind in _MASTER:
            if group is not None:
                yield from _frames(*group, scale, tracks)
                group = None
            at = body
            continue
        data = raw[body:end]
        if kind == 0x2AD7B1:
            scale = int.from_bytes(data, "big")
        elif kind == 0xD7:
            number = int.from_bytes(data, "big")
        elif kind == 0x86:
            tracks[number] = data.rstrip(b"\0").decode("latin-1"), tracks.get(number, ("", 0))[1]
        elif kind == 0x23E383:
            tracks[number] = tracks.get(number, ("", 0))[0], int.from_bytes(data, "big")
        elif kind == 0xE7:
            cluster = int.from_bytes(data, "big")
        elif kind == 0xA3:
            yield from _frames(data, cluster, None, scale, tracks)
        elif kind == 0xA1:
            group = (data, cluster, True)
        elif kind == 0xFB and group is not None:
            group = (group[0], group[1], False)
        at = end
    if group is not None:
        yield from _frames(*group, scale, tracks)


def _frames(block: bytes, cluster: int, key: bool | None, scale: int, tracks: dict[int, tuple[str, int]]) -> Iterator[tuple]:
    track, at = element_size(block, 0)
    time, flags = struct.unpack_from(">hB", block, at)
    key = bool(flags & 0x80) if key is None else key
    codec, duration = tracks.get(track, ("", 0))
    for i, frame in enumerate(lacing(block, at + 3, flags >> 1 & 3)):
        t = ((cluster + time) * scale + i * duration) // 1000
        yield track, _CODECS.get(codec, codec), 1_000_000, t, t, key, 0, frame


# AVI
def _riff(raw: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, start, end) of the chunks of a range; the id of a list is its kind."""
    while start + 8 <= end:
        name, size = struct.unpack_from("<4sI", raw, start)
        stop = min(end, start + 8 + size)
        listed = name in (b"LIST", b"RIFF")
        yield (raw[start + 8 : start + 12] if listed else name), start + (12 if listed else 8), stop
        start += 8 + size + (size & 1)


_AVI_CODECS = {b"H264": "h264", b"h264": "h264", b"avc1": "h264", b"MJPG": "mjpeg", 0x55: "mp3", 0xFF: "aac", 1: "pcm"}


def avi_packets(raw: bytes) -> Iterator[tuple]:
    """Chunks in file order, timed by their stream's rate: a tick a chunk, or a tick a block of bytes where the stream has a sample size.

    Key chunks are those that the index marks; without an index those of other
    streams than video, and H.264 chunks with an IDR unit.
    """
    streams, keys, movi, index = [], set(), None, None
    for kind, a, b in _riff(raw, 0, len(raw)):
        for name, c, d in _riff(raw, a, b) if kind == b"AVI " else ():
            if name == b"hdrl":
                for sub, e, f in _riff(raw, c, d):
                    if sub == b"strl":
                        own = {n: raw[x:y] for n, x, y in _riff(raw, e, f)}
                        fourcc, handler = own[b"strh"][:4], own[b"strh"][4:8]
                        scale, rate, start = struct.unpack_from("<III", own[b"strh"], 20)
                        size = struct.unpack_from("<I", own[b"strh"], 44)[0]
                        code = struct.unpack_from("<H", own[b"strf"])[0] if fourcc == b"auds" else handler
                        streams.append({"video": fourcc == b"vids", "codec": _AVI_CODECS.get(code, str(code)), "scale": scale, "rate": rate, "size": size, "at": start})
            elif name == b"movi":
                movi = c, d
            elif name == b"idx1":
                index = c, d
    if movi is None:
        return
    if index is not None:
        entries = list(struct.iter_unpack("<4sIII", raw[index[0] : index[0] + (index[1] - index[0]) // 16 * 16]))
        base = 0 if entries and entries[0][2] >= movi[0] else movi[0] - 4
        keys = {base + at + 8 for _, flags, at, _ in entries if flags & 0x10}
    todo = [movi]
    while todo:
        a, b = todo.pop()
        for name, c, d in _riff(raw, a, b):
            if name == b"rec ":
                todo.append((d, b))
                todo.append((c, d))
                break
            if not name[:2].isdigit() or int(name[:2]) >= len(streams):
                continue
            n = int(name[:2])
            s = streams[n]
            payload = raw[c:d]
            key = c in keys if index is not None else not s["video"] or any(u[0] & 31 == 5 for u in bits.nal_units(payload))
            t = s["at"] * s["scale"] * 1_000_000 // s["rate"]
            s["at"] += len(payload) // s["size"] if s["size"] else 1
            yield n, s["codec"], 1_000_000, t, t, key, 0, payload


# Fragmented MP4
def fragment_packets(raw: bytes) -> Iterator[tuple]:
    """Samples of all movie fragments, with the tracks of the movie box."""
    names = {"avc1": "h264", "mp4a": "aac", "hvc1": "h265"}
    known = {}
    for kind, a, b in boxes(raw, *(find_box(raw, "moov") or (0, 0))):
        if kind == b"trak":
            tkhd, mdhd, stsd = find_box(raw, "tkhd", a, b), find_box(raw, "mdia/mdhd", a, b), find_box(raw, "mdia/minf/stbl/stsd", a, b)
            ident = struct.unpack_from(">I", raw, tkhd[0] + (20 if raw[tkhd[0]] == 1 else 12))[0]
            scale = struct.unpack_from(">I", raw, mdhd[0] + (20 if raw[mdhd[0]] == 1 else 12))[0]
            codec = raw[stsd[0] + 12 : stsd[0] + 16].decode("latin-1")
            known[ident] = len(known), names.get(codec, codec), scale
    for kind, a, b in boxes(raw):
        if kind != b"moof":
            continue
        for part, c, d in boxes(raw, a, b):
            if part == b"traf":
                yield from _fragment(raw, a - 8, c, d, known)


def _fragment(raw: bytes, base: int, a: int, b: int, known: dict[int, tuple]) -> Iterator[tuple]:
    track, standard = None, [0, 0, 0]  # duration, size, flags
    dts = 0
    for kind, c, d in boxes(raw, a, b):
        flags = int.from_bytes(raw[c + 1 : c + 4], "big")
        if kind == b"tfhd":
            track, at = struct.unpack_from(">I", raw, c + 4)[0], c + 8
            if flags & 1:
                base, at = struct.unpack_from(">Q", raw, at)[0], at + 8
            at += 4 if flags & 2 else 0
            for i, bit in enumerate((8, 16, 32)):
                if flags & bit:
                    standard[i], at = struct.unpack_from(">I", raw, at)[0], at + 4
        elif kind == b"tfdt":
            dts = struct.unpack_from(">Q" if raw[c] else ">I", raw, c + 4)[0]
        elif kind == b"trun" and track in known:
            count, at, place, first = struct.unpack_from(">I", raw, c + 4)[0], c + 8, base, None
            if flags & 1:
                place, at = base + struct.unpack_from(">i", raw, at)[0], at + 4
            if flags & 4:
                first, at = struct.unpack_from(">I", raw, at)[0], at + 4
            for i in range(count):
                own, shift = list(standard), 0
                for j, bit in enumerate((0x100, 0x200, 0x400)):
                    if flags & bit:
                        own[j], at = struct.unpack_from(">I", raw, at)[0], at + 4
                if flags & 0x800:
                    shift, at = struct.unpack_from(">i" if raw[c] else ">I", raw, at)[0], at + 4
                if i == 0 and first is not None:
                    own[2] = first
                number, codec, scale = known[track]
                yield number, codec, scale, dts + shift, dts, not own[2] & 0x10000, 0, raw[place : place + own[1]]
                dts, place = dts + own[0], place + own[1]


def read_packets(raw: bytes) -> list[tuple]:
    """All packets of a file, by its magic bytes."""
    if raw[:3] == b"FLV":
        return list(flv_packets(raw))
    if raw[:4] == b"OggS":
        return [(s, "opus" if p[:4] == b"Opus" else "", 48000, g, g, True, 0, p) for s, g, p in ogg_packets(raw)]
    if raw[:4] == b"\x1a\x45\xdf\xa3":
        head, at = element_size(raw, 4)
        return list(matroska_packets(raw[at + (head or 0) :]))
    if raw[:4] == b"RIFF" and raw[8:12] == b"AVI ":
        return list(avi_packets(raw))
    if raw[4:8] == b"ftyp" and find_box(raw, "moof"):
        return list(fragment_packets(raw))
    if raw[4:8] == b"ftyp":
        return list(mp4_packets(raw))
    raise ValueError("neither FLV, Ogg, Matroska, AVI nor MP4")


def packets(files: DataFrame) -> DataFrame:
    """One row a packet of files read with format binaryFile."""
    fields = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = read_packets(content.as_py())
                columns = [[os.path.basename(path)] * len(rows), *(zip(*rows, strict=True) if rows else [[]] * 8)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, fields, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
