"""Containers written from packets: MP4 whole and in fragments, Matroska, AVI, MPEG-TS segments, RTMP chunks.

``write_files`` makes one file for each source of a packet table; a task holds
the packets of the source it writes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from wavelattice.sources.bits import ts_crc


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, bytes(4), *parts)


def _ints(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def _run_lengths(values: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [tuple(x) for x in out]


MOVIE_SCALE = 1000
# Sines of the quarter turns in 16.16.
_TURNS = {0: (1, 0), 90: (0, 1), 180: (-1, 0), 270: (0, -1)}


def track_header(number: int, duration: int, width: int = 0, height: int = 0, rotation: int = 0) -> bytes:
    """A tkhd box with a picture's size and turn."""
    c, s = (v << 16 for v in _TURNS[rotation])
    matrix = struct.pack(">9i", c, s, 0, -s, c, 0, 0, 0, 1 << 30)
    return full_box(b"tkhd", _ints(0, 0, number, 0, duration), bytes(16), matrix, _ints(width << 16, height << 16))


def mp4(tracks: list[dict]) -> bytes:
    """A file with its index in front, of tracks (codec, timescale, packets of (pts, dts, is_keyframe, payload)).

    A track may have width, height and rotation, and edits (duration in
    milliseconds, media start or -1 for an empty edit).
    """
    head = box(b"ftyp", b"isom", bytes(4), b"isom")

    def index(base: int) -> bytes:
        out, at, longest = b"", base, 0
        for n, t in enumerate(tracks, 1):
            p = t["packets"]
            dts = [x[1] for x in p]
            steps = [b - a for a, b in zip(dts, dts[1:], strict=False)]
            steps.append(steps[-1] if steps else 1)
            shifts = [x[0] - x[1] for x in p]
            stts, ctts, sync = _run_lengths(steps), _run_lengths(shifts), [i for i, x in enumerate(p, 1) if x[2]]
            tables = [
                full_box(b"stsd", _ints(1), box(t["codec"].encode(), bytes(8))),
                full_box(b"stts", _ints(len(stts), *(v for r in stts for v in r))),
                *([full_box(b"ctts", _ints(len(ctts)), b"".join(struct.pack(">Ii", *r) for r in ctts))] if any(shifts) else []),
                *([full_box(b"stss", _ints(len(sync), *sync))] if len(sync) < len(p) else []),
                full_box(b"stsc", _ints(1, 1, len(p), 1)),
                full_box(b"stsz", _ints(0, len(p), *(len(x[3]) for x in p))),
                full_box(b"stco", _ints(1, at)),
            ]
            at += sum(len(x[3]) for x in p)
            length = sum(steps) * MOVIE_SCALE // t["timescale"]
            longest = max(longest, length)
            handler = full_box(b"hdlr", _ints(0), b"vide" if t.get("width") else b"soun", bytes(13))
            media = box(b"mdia", full_box(b"mdhd", _ints(0, 0, t["timescale"], sum(steps), 0x55C40000)), handler, box(b"minf", box(b"stbl", *tables)))
            edits = b"".join(struct.pack(">IiI", d, start, 0x10000) for d, start in t.get("edits", ()))
            listed = [box(b"edts", full_box(b"elst", _ints(len(t["edits"])), edits))] if edits else []
            out += box(b"trak", track_header(n, length, *(t.get(k, 0) for k in ("width", "height", "rotation"))), *listed, media)
        return box(b"moov", full_box(b"mvhd", _ints(0, 0, MOVIE_SCALE, longest, 0x10000), bytes(76), _ints(len(tracks) + 1)), out)

    data = b"".join(x[3] for t in tracks for x in t["packets"])
    return head + index(len(head) + len(index(0)) + 8) + box(b"mdat", data)


# Fragmented MP4
def fmp4_init(tracks: list[dict]) -> bytes:
    """The segment that describes tracks (codec, timescale), without samples."""
    out, extends = full_box(b"mvhd", _ints(0, 0, 1000, 0, 0x10000), bytes(76), _ints(len(tracks) + 1)), b""
    for n, t in enumerate(tracks, 1):
        empty = [full_box(k, _ints(0)) for k in (b"stts", b"stsc", b"stco")] + [full_box(b"stsz", _ints(0, 0))]
        table = box(b"stbl", full_box(b"stsd", _ints(1), box(t["codec"].encode(), bytes(8))), *empty)
        media = box(b"mdia", full_box(b"mdhd", _ints(0, 0, t["timescale"], 0, 0x55C40000)), box(b"minf", table))
        out += box(b"trak", full_box(b"tkhd", _ints(0, 0, n, 0, 0), bytes(60)), media)
        extends += full_box(b"trex", _ints(n, 1, 0, 0, 0))
    return box(b"ftyp", b"iso5", bytes(4), b"iso5iso6mp41") + box(b"moov", out, box(b"mvex", extends))


def sample_durations(dts: list[int], next_dts: int | None = None) -> list[int]:
    """Each sample lasts until the next one's decode time; the last as long as the one before it where nothing follows."""
    steps = [b - a for a, b in zip(dts, dts[1:], strict=False)]
    last = next_dts - dts[-1] if next_dts is not None else steps[-1] if steps else 1
    return [*steps, last]


def fmp4_segment(sequence: int, tracks: list[tuple[int, list[tuple[int, int, bool, bytes]], int | None]]) -> bytes:
    """One movie fragment of (track number from 1, packets of (pts, dts, is_keyframe, payload), next dts)."""

    def head(start: int) -> bytes:
        parts, at = full_box(b"mfhd", _ints(sequence)), start
        for number, packets, after in tracks:
            rows = b""
            for (pts, dts, key, payload), length in zip(packets, sample_durations([p[1] for p in packets], after), strict=True):
                rows += struct.pack(">IIIi", length, len(payload), 0x02000000 if key else 0x01010000, pts - dts)
            run = box(b"trun", b"\x01\0\x0f\x01", struct.pack(">Ii", len(packets), at), rows)
            at += sum(len(p[3]) for p in packets)
            parts += box(b"traf", box(b"tfhd", b"\0\x02\0\0", _ints(number)), box(b"tfdt", b"\x01\0\0\0", struct.pack(">Q", packets[0][1])), run)
        return box(b"moof", parts)

    tracks = [t for t in tracks if t[1]]
    return head(len(head(0)) + 8) + box(b"mdat", *(p[3] for _, packets, _ in tracks for p in packets))


# Matroska
def _size(n: int, width: int | None = None) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (1 << 7 * width | n).to_bytes(width, "big")


def element(ident: int, *parts: bytes | int | float | str) -> bytes:
    """An element of bytes, unsigned numbers, floats or text."""
    body = b""
    for p in parts:
        if isinstance(p, int):
            p = p.to_bytes(max(1, (p.bit_length() + 7) // 8), "big")
        elif isinstance(p, float):
            p = struct.pack(">d", p)
        body += p.encode() if isinstance(p, str) else p
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


# Codec ids, and the span that a block's 16-bit time allows in a cluster.
MATROSKA_CODECS = {"h264": "V_MPEG4/ISO/AVC", "h265": "V_MPEGH/ISO/HEVC", "aac": "A_AAC", "opus": "A_OPUS", "mp3": "A_MPEG/L3"}
CLUSTER_MS = 30_000


def matroska(tracks: dict[int, str], packets: list[tuple[int, int, bool, bytes]], seekable: bool = True) -> bytes:
    """A file of tracks (number: codec) and packets (track, pts in ms, is_keyframe, payload) in their order.

    A cluster ends after CLUSTER_MS, or where a time would lie too far from its
    start. With cues for key packets and known sizes if seekable, else as a
    live stream: unknown sizes, no cues.
    """
    entries = b""
    for number, codec in tracks.items():
        video = codec in ("h264", "h265")
        detail = element(0xE0, element(0xB0, 16), element(0xBA, 16)) if video else element(0xE1, element(0xB5, 48000.0), element(0x9F, 2))
        entries += element(0xAE, element(0xD7, number), element(0x73C5, number), element(0x83, 1 if video else 2), element(0x86, MATROSKA_CODECS[codec]), detail)
    end = max((p[1] for p in packets), default=0)
    info = element(0x1549A966, element(0x2AD7B1, 1_000_000), element(0x4D80, "muxer"), element(0x5741, "muxer"), *([element(0x4489, float(end))] if seekable else []))
    body, cues = info + element(0x1654AE6B, entries), b""
    groups: list[tuple[int, list]] = []
    for p in packets:
        if not groups or not -32768 <= p[1] - groups[-1][0] <= CLUSTER_MS:
            groups.append((max(p[1], 0), []))
        groups[-1][1].append(p)
    for start, own in groups:
        at, blocks = len(body), b""
        for track, pts, key, payload in own:
            if key and track == next(iter(tracks)):
                cues += element(0xBB, element(0xB3, max(pts, 0)), element(0xB7, element(0xF7, track), element(0xF1, at)))
            blocks += element(0xA3, _size(track) + struct.pack(">hB", pts - start, 0x80 if key else 0), payload)
        cluster = element(0xE7, start) + blocks
        body += element(0x1F43B675, cluster) if seekable else b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + cluster
    if seekable and cues:
        body += element(0x1C53BB6B, cues)
    head = element(0x1A45DFA3, element(0x4286, 1), element(0x42F7, 1), element(0x42F2, 4), element(0x42F3, 8), element(0x4282, "matroska"), element(0x4287, 4), element(0x4285, 2))
    return head + b"\x18\x53\x80\x67" + (_size(len(body), 8) if seekable else b"\x01" + b"\xff" * 7) + body


# AVI
def _riff_chunk(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


# What a stream's header says of a codec.
AVI_HANDLERS = {"h264": (b"vids", b"H264", 0), "mp3": (b"auds", bytes(4), 0x55), "aac": (b"auds", bytes(4), 0xFF)}


def avi(streams: list[tuple[str, int, int]], packets: list[tuple[int, bool, bytes]]) -> bytes:
    """A file of streams (codec, rate, scale; a packet lasts scale / rate seconds) and packets (stream, is_keyframe, payload) with an index."""
    counts = [sum(p[0] == i for p in packets) for i in range(len(streams))]
    listed = b""
    for (codec, rate, scale), n in zip(streams, counts, strict=True):
        kind, handler, tag = AVI_HANDLERS[codec]
        head = kind + handler + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, scale, rate, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, 0, 0)
        form = struct.pack("<IiiHH4sIiiII", 40, 16, 16, 1, 24, handler, 0, 0, 0, 0, 0) if kind == b"vids" else struct.pack("<HHIIHHH", tag, 2, 48000, 16000, 1, 0, 0)
        listed += _riff_chunk(b"LIST", b"strl", _riff_chunk(b"strh", head), _riff_chunk(b"strf", form))
    main = struct.pack("<10I4I", streams[0][2] * 1_000_000 // streams[0][1], 0, 0, 0x10, counts[0], 0, len(streams), 0, 16, 16, 0, 0, 0, 0)
    data, index = b"movi", b""
    for stream, key, payload in packets:
        name = b"%02d" % stream + (b"dc" if AVI_HANDLERS[streams[stream][0]][0] == b"vids" else b"wb")
        index += name + struct.pack("<III", 0x10 if key else 0, len(data), len(payload))
        data += _riff_chunk(name, payload)
    return _riff_chunk(b"RIFF", b"AVI ", _riff_chunk(b"LIST", b"hdrl", _riff_chunk(b"avih", main), listed), _riff_chunk(b"LIST", data), _riff_chunk(b"idx1", index))


def _ts_packets(pid: int, payload: bytes, counter: dict[int, int], pcr: int | None = None) -> bytes:
    """188-byte packets of one unit."""
    out, first = b"", True
    while payload or first:
        field = b""
        if first and pcr is not None:
            field = b"\x10" + (pcr % (1 << 33) << 15 | 0x7E00).to_bytes(6, "big")
        room = 184 - (len(field) + 1 if field else 0)
        take = payload[:room]
        payload = payload[len(take) :]
        if len(take) < room:
            pad = room - len(take)
            if field:
                field += b"\xff" * pad
            elif pad == 1:
                field = None
            else:
                field = b"\0" + b"\xff" * (pad - 2)
        n = counter.get(pid, 0)
        counter[pid] = (n + 1) & 15
        adaptation = b"\0" if field is None else bytes([len(field)]) + field if field else b""
        out += struct.pack(">BHB", 0x47, (0x4000 if first else 0) | pid, (0x30 if adaptation else 0x10) | n) + adaptation + take
        first = False
    return out


def _section(table: int, ident: int, body: bytes) -> bytes:
    s = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, ident, 0xC1, 0, 0) + body
    return b"\0" + s + struct.pack(">I", ts_crc(s))


def _stamp(prefix: int, t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([prefix << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


# Stream types and ids.
TS_KINDS = {"h264": (0x1B, 0xE0), "aac": (0x0F, 0xC0), "mp3": (0x03, 0xC0)}


def ts_segment(codecs: dict[int, str], packets: list[tuple[int, int, int, bytes]], counter: dict[int, int] | None = None) -> bytes:
    """A transport stream segment of (track, pts, dts, payload) in 90 kHz ticks, in stable order of dts."""
    counter = {} if counter is None else counter
    pids = {track: 256 + i for i, track in enumerate(codecs)}
    lead = next((t for t, c in codecs.items() if c == "h264"), next(iter(codecs)))
    streams = b"".join(struct.pack(">BHH", TS_KINDS[c][0], 0xE000 | pids[t], 0xF000) for t, c in codecs.items())
    out = _ts_packets(0, _section(0, 1, struct.pack(">HH", 1, 0xE000 | 4096)), counter)
    out += _ts_packets(4096, _section(2, 1, struct.pack(">HH", 0xE000 | pids[lead], 0xF000) + streams), counter)
    for track, pts, dts, payload in sorted(packets, key=lambda p: p[2]):
        times = _stamp(3, pts) + _stamp(1, dts) if pts != dts else _stamp(2, pts)
        size = len(payload) + 3 + len(times)
        kind = TS_KINDS[codecs[track]][1]
        pes = b"\0\0\1" + bytes([kind]) + struct.pack(">H", size if size < 65536 and kind != 0xE0 else 0) + bytes([0x80, 0xC0 if pts != dts else 0x80, len(times)]) + times + payload
        out += _ts_packets(pids[track], pes, counter, max(0, dts - 63000) if track == lead else None)
    return out


def rtmp_messages(raw: bytes, chunk: int = 128) -> Iterator[tuple[int, int, int, bytes]]:
    """(type, stream, time, payload) of a captured chunk stream; set-chunk-size messages take effect."""
    at, state = 0, {}
    while at < len(raw):
        kind, channel, at = raw[at] >> 6, raw[at] & 63, at + 1
        if channel < 2:
            n = channel + 1
            channel, at = int.from_bytes(raw[at : at + n], "little") + 64, at + n
        s = state.setdefault(channel, {"time": 0, "delta": 0, "size": 0, "type": 0, "stream": 0, "data": b"", "long": False})
        fresh = not s["data"]
        if kind < 3:
            stamp, at = int.from_bytes(raw[at : at + 3], "big"), at + 3
            if kind < 2:
                s["size"], s["type"], at = int.from_bytes(raw[at : at + 3], "big"), raw[at + 3], at + 4
            if kind == 0:
                s["stream"], at = int.from_bytes(raw[at : at + 4], "little"), at + 4
            s["long"] = stamp == 0xFFFFFF
            if s["long"]:
                stamp, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
            s["time"] = stamp if kind == 0 else (s["time"] + stamp) % (1 << 32)
            s["delta"] = stamp
        else:
            at += 4 * s["long"]
            if fresh:
                s["time"] = (s["time"] + s["delta"]) % (1 << 32)
        take = raw[at : at + min(chunk, s["size"] - len(s["data"]))]
        at += len(take)
        s["data"] += take
        if len(s["data"]) == s["size"]:
            yield s["type"], s["stream"], s["time"], s["data"]
            if s["type"] == 1 and len(s["data"]) >= 4:
                chunk = max(1, int.from_bytes(s["data"][:4], "big") & 0x7FFFFFFF)
            s["data"] = b""
        elif not take:
            return


def rtmp_chunks(messages: list[tuple[int, int, int, bytes]], chunk: int = 128, channel: int = 4) -> bytes:
    """Messages as full-header chunks on one channel."""
    out = b""
    for kind, stream, time, payload in messages:
        stamp = min(time, 0xFFFFFF)
        late = struct.pack(">I", time) if stamp == 0xFFFFFF else b""
        out += bytes([channel]) + stamp.to_bytes(3, "big") + len(payload).to_bytes(3, "big") + bytes([kind]) + struct.pack("<I", stream) + late + payload[:chunk]
        for a in range(chunk, len(payload), chunk):
            out += bytes([0xC0 | channel]) + late + payload[a : a + chunk]
    return out


def write_files(packets: DataFrame, folder: str, timescales: dict[int, tuple[str, int]]) -> DataFrame:
    """One MP4 a source (source_id, track_id, pts, dts, is_keyframe, payload) below ``folder``; names and sizes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracks = []
        for t, rows in pdf.groupby("track_id"):
            rows = rows.sort_values("dts")
            codec, scale = timescales[int(t)]
            columns = (rows[c].tolist() for c in ("pts", "dts", "is_keyframe", "payload"))
            tracks.append({"codec": codec, "timescale": scale, "packets": list(zip(*columns, strict=True))})
        raw, name = mp4(tracks), os.path.join(folder, f"{pdf['source_id'].iloc[0]}.mp4")
        os.makedirs(folder, exist_ok=True)
        with open(f"{name}.{os.getpid()}", "wb") as f:
            f.write(raw)
        os.replace(f"{name}.{os.getpid()}", name)
        return pd.DataFrame({"file": [name], "size": [len(raw)]})

    return packets.groupBy("source_id").applyInPandas(run, "file string, size long")
