"""Readers and writers of PCM files: WAV, AU and AIFF/AIFC, as Spark data sources.

``spark.read.format("pcm")`` gives block rows (clip_id, channels, sample_rate,
bits, block_no, start_frame, pcm). A file is cut into runs of blocks, each a
partition of its own, so that a long recording is read in parallel; only
compressed formats without random access stay whole. Samples keep their
native range; float formats become 32-bit integers. A filter on clip_id is
pushed down to the list of files.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

from wavelattice.sources import adpcm, g711
from wavelattice.sources.sniff import id3v2, id3v2_bytes

BLOCK_FRAMES = 4096
WHOLE = ("ima", "ms", "yamaha", "ima4")  # formats whose frames depend on those before
SCHEMA = "clip_id string, channels int, sample_rate int, bits int, block_no long, start_frame long, pcm array<int>"


@dataclass(frozen=True)
class Layout:
    """Where a file's samples lie and how they are coded."""

    kind: str  # s, u, f, alaw, mulaw, ima, ms, yamaha, ima4
    big_endian: bool
    channels: int
    rate: int
    bits: int  # of a coded sample
    start: int
    size: int
    block: int = 0
    block_frames: int = 0
    total: int = -1
    tags: tuple = ()
    coefficients: tuple = ()

    @property
    def width(self) -> int:
        return self.channels * self.bits // 8

    @property
    def frames(self) -> int:
        if self.kind == "ima4":
            return self.size // (adpcm.IMA4_BYTES * self.channels) * adpcm.IMA4_FRAMES
        if self.kind in ("ima", "ms"):
            whole = -(-self.size // self.block) * self.block_frames
            return min(whole, self.total) if self.total >= 0 else whole
        if self.kind == "yamaha":
            return self.size * 2 // self.channels
        return self.size // self.width

    @property
    def out_bits(self) -> int:
        return {"f": 32, "u": 8}.get(self.kind, 16 if self.kind in ("alaw", "mulaw", *WHOLE) else self.bits)


def _chunks(f, start: int, end: int, order: str) -> Iterator[tuple[bytes, int, int]]:
    """(id, offset, size) of RIFF or IFF chunks; a size that runs past the end is cut."""
    at = start
    while at + 8 <= end:
        f.seek(at)
        name, size = struct.unpack(order + "4sI", f.read(8))
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def _wav(f, end: int) -> Layout:
    fmt, data, total, tags = None, None, -1, []
    for name, at, size in _chunks(f, 12, end, "<"):
        f.seek(at)
        if name == b"fmt ":
            fmt = f.read(size)
        elif name == b"fact" and size >= 4:
            total = struct.unpack("<I", f.read(4))[0]
        elif name == b"LIST" and f.read(4) == b"INFO":
            for key, k_at, k_size in _chunks(f, at + 4, at + size, "<"):
                f.seek(k_at)
                tags.append((key.decode("latin-1"), f.read(k_size).split(b"\0")[0].decode("utf-8", "replace")))
        elif name == b"data" and data is None:
            data = at, size if size else end - at
    if fmt is None or data is None:
        raise ValueError("no fmt or data chunk")
    tag, channels, rate, _, align, bits = struct.unpack("<HHIIHH", fmt[:16])
    if tag == 0xFFFE and len(fmt) >= 26:
        tag = struct.unpack("<H", fmt[24:26])[0]
    kinds = {1: "u" if bits == 8 else "s", 3: "f", 6: "alaw", 7: "mulaw", 0x11: "ima", 2: "ms", 0x20: "yamaha"}
    if tag not in kinds:
        raise ValueError(f"format tag {tag} is not supported")
    per_block = struct.unpack("<H", fmt[18:20])[0] if tag in (2, 0x11) and len(fmt) >= 20 else 0
    pairs = ()
    if tag == 2 and len(fmt) >= 22:
        pairs = tuple(struct.iter_unpack("<hh", fmt[22 : 22 + 4 * min(struct.unpack_from("<H", fmt, 20)[0], (len(fmt) - 22) // 4)]))
    return Layout(kinds[tag], False, channels, rate, bits, data[0], data[1], align, per_block, total, tuple(tags), pairs)


def _au(f, end: int) -> Layout:
    f.seek(4)
    start, size, code, rate, channels = struct.unpack(">5I", f.read(20))
    kinds = {1: ("mulaw", 8), 2: ("s", 8), 3: ("s", 16), 4: ("s", 24), 5: ("s", 32), 6: ("f", 32), 7: ("f", 64), 27: ("alaw", 8)}
    if code not in kinds:
        raise ValueError(f"encoding {code} is not supported")
    f.seek(24)
    note = f.read(max(0, start - 24)).split(b"\0")[0].decode("utf-8", "replace")
    return Layout(*(kinds[code][0], True, channels, rate, kinds[code][1]), start, end - start if size == 0xFFFFFFFF else min(size, end - start), tags=(("comment", note),) if note else ())


def extended(b: bytes) -> float:
    """An 80-bit extended float, big-endian."""
    sign, exponent, mantissa = b[0] >> 7, (b[0] & 0x7F) << 8 | b[1], int.from_bytes(b[2:10], "big")
    value = mantissa * 2.0 ** (exponent - 16383 - 63) if mantissa else 0.0
    return -value if sign else value


def to_extended(x: float) -> bytes:
    """The 80-bit form of a positive number."""
    m, e = np.frexp(x)
    return struct.pack(">HQ", int(e) - 1 + 16383, int(m * 2.0**64)) if x else bytes(10)


def _aiff(f, end: int) -> Layout:
    f.seek(8)
    compressed, common, data, tags = f.read(4) == b"AIFC", None, None, []
    for name, at, size in _chunks(f, 12, end, ">"):
        f.seek(at)
        if name == b"COMM":
            common = f.read(size)
        elif name == b"SSND":
            skip = struct.unpack(">I", f.read(4))[0]
            data = at + 8 + skip, size - 8 - skip
        elif name in (b"NAME", b"AUTH", b"(c) ", b"ANNO"):
            tags.append((name.decode().strip(), f.read(size).rstrip(b"\0").decode("utf-8", "replace")))
        elif name == b"ID3 ":
            tags += id3v2(f.read(size)).items()
    if common is None or data is None:
        raise ValueError("no COMM or SSND chunk")
    channels, _, bits = struct.unpack(">HIH", common[:8])
    form = common[18:22] if compressed else b"NONE"
    kinds = {b"NONE": ("s", True, bits), b"twos": ("s", True, bits), b"sowt": ("s", False, bits), b"fl32": ("f", True, 32), b"FL32": ("f", True, 32), b"fl64": ("f", True, 64), b"alaw": ("alaw", True, 8), b"ulaw": ("mulaw", True, 8), b"ima4": ("ima4", True, 8)}
    if form not in kinds:
        raise ValueError(f"compression {form!r} is not supported")
    kind, big, width = kinds[form]
    return Layout(kind, big, channels, round(extended(common[8:18])), -(-width // 8) * 8, *data, tags=tuple(tags))


def layout(f) -> Layout:
    """The layout of an open file, by its magic bytes."""
    f.seek(0, 2)
    end = f.tell()
    f.seek(0)
    head = f.read(12)
    if head[:4] == b"RIFF" and head[8:] == b"WAVE":
        return _wav(f, end)
    if head[:4] == b".snd":
        return _au(f, end)
    if head[:4] == b"FORM" and head[8:] in (b"AIFF", b"AIFC"):
        return _aiff(f, end)
    raise ValueError("neither WAV, AU nor AIFF")


def decode(raw: bytes, x: Layout) -> np.ndarray:
    """Samples (frames by channels) of whole coded frames or blocks."""
    order = ">" if x.big_endian else "<"
    if x.kind == "u":
        out = np.frombuffer(raw, np.uint8).astype(np.int32) - 128
    elif x.kind in ("alaw", "mulaw"):
        out = (g711.ALAW if x.kind == "alaw" else g711.MULAW)[np.frombuffer(raw, np.uint8)]
    elif x.kind == "f":
        v = np.nan_to_num(np.frombuffer(raw, f"{order}f{x.bits // 8}").astype(np.float64), nan=0.0, posinf=1.0, neginf=-1.0)
        out = np.trunc(np.clip(v, -1, 1) * 2147483647.0).astype(np.int32)
    elif x.kind in WHOLE:
        return adpcm.decode(raw, x.kind, x.channels, x.block, x.block_frames)
    elif x.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)[:, :: -1 if x.big_endian else 1].astype(np.int32)
        out = (b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8
    else:
        out = np.frombuffer(raw, f"{order}i{x.bits // 8}").astype(np.int32)
    return out.reshape(-1, x.channels)


class _Part(InputPartition):
    """The ``index``-th of ``count`` equal runs of a file's blocks."""

    def __init__(self, path: str, index: int, count: int):
        self.path, self.index, self.count = path, index, count


_BLOCKS = pa.schema(
    [("clip_id", pa.string()), ("channels", pa.int32()), ("sample_rate", pa.int32()), ("bits", pa.int32()), ("block_no", pa.int64()), ("start_frame", pa.int64()), ("pcm", pa.list_(pa.int32()))]
)


class PcmReader(DataSourceReader):
    """The driver only asks for the files' sizes; headers are read by the tasks, blocks leave as Arrow batches."""

    def __init__(self, paths: list[str], block: int, part_bytes: int):
        self.paths, self.block, self.part_bytes = paths, block, part_bytes

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("clip_id",):
                self.paths = [p for p in self.paths if os.path.basename(p) == f.value]
            yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            count = max(1, -(-os.path.getsize(path) // self.part_bytes))
            out += [_Part(path, i, count) for i in range(count)]
        return out or [_Part("", 0, 1)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with open(part.path, "rb") as f:
            x = layout(f)
            name = os.path.basename(part.path)
            blocks = -(-x.frames // self.block)
            first, last = blocks * part.index // part.count, blocks * (part.index + 1) // part.count
            if x.kind in WHOLE:
                if part.index:
                    return  # frames depend on those before, so the first task reads the file
                first, last = 0, blocks
                f.seek(x.start)
                samples = decode(f.read(x.size), x)[: x.frames]
                source = lambda a, n: samples[a : a + n]
            else:

                def source(a: int, n: int) -> np.ndarray:
                    f.seek(x.start + a * x.width)
                    return decode(f.read(n * x.width), x)

            for k in range(first, last):
                a = k * self.block
                flat = source(a, min(self.block, x.frames - a)).reshape(-1)
                values = [[name], [x.channels], [x.rate], [x.out_bits], [k], [a]]
                columns = [pa.array(v, t.type) for v, t in zip(values, _BLOCKS, strict=False)]
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=_BLOCKS)


class PcmWriter(DataSourceWriter):
    """One WAV file a clip; a task needs whole clips, ordered by start_frame."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        clip, parts, info = None, [], None
        os.makedirs(self.path, exist_ok=True)
        for r in rows:
            if r.clip_id != clip:
                if clip is not None:
                    self._save(clip, parts, info)
                clip, parts, info = r.clip_id, [], (r.channels, r.sample_rate, r.bits)
            parts.append(np.asarray(r.pcm, np.int64))
        if clip is not None:
            self._save(clip, parts, info)
        return WriterCommitMessage()

    def _save(self, clip: str, parts: list[np.ndarray], info: tuple[int, int, int]) -> None:
        name = os.path.join(self.path, clip if clip.endswith(".wav") else f"{clip}.wav")
        temporary = f"{name}.{os.getpid()}"
        with open(temporary, "wb") as f:
            f.write(wav_bytes(np.concatenate(parts), *info))
        os.replace(temporary, name)


class PcmSource(DataSource):
    """Options: path (a file, folder or pattern on a mount that driver and executors share), blockframes, partitionbytes."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PcmReader:
        path = self.options["path"].removeprefix("file://")
        paths = sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else sorted(glob.glob(path))
        block = int(self.options.get("blockframes", BLOCK_FRAMES))
        return PcmReader(paths, block, max(1, int(self.options.get("partitionbytes", 16 << 20))))

    def writer(self, schema, overwrite: bool) -> PcmWriter:
        return PcmWriter(self.options["path"].removeprefix("file://"))


def _signed(pcm: np.ndarray, bits: int, order: str) -> bytes:
    """Samples in whole bytes."""
    if bits == 24:
        cut = slice(1, 4) if order == ">" else slice(0, 3)
        return np.asarray(pcm, f"{order}i4").view(np.uint8).reshape(-1, 4)[:, cut].tobytes()
    return np.asarray(pcm).astype(f"{order}i{bits // 8}").tobytes()


# Format tags of the coded forms of WAV.
WAV_TAGS = {"ima": 0x11, "ms": 2, "yamaha": 0x20}


def info_list(tags: dict[str, str]) -> bytes:
    """A LIST chunk of INFO entries by their four-letter ids; empty without tags."""
    entries = b""
    for key, value in tags.items():
        text = value.encode() + b"\0"
        entries += struct.pack("<4sI", key.encode("latin-1"), len(text)) + text + b"\0" * (len(text) & 1)
    return struct.pack("<4sI", b"LIST", len(entries) + 4) + b"INFO" + entries if tags else b""


def wav_bytes(pcm: np.ndarray, channels: int, rate: int, bits: int, tag: int = 1, tags: dict[str, str] | None = None) -> bytes:
    """A WAV file of interleaved samples; tag 3 takes floats, 6 and 7 code 16-bit samples by G.711, 2, 0x11 and 0x20 by ADPCM."""
    extra, fact, frames = b"", b"", len(pcm) // channels
    if tag in WAV_TAGS.values():
        kind = next(k for k, t in WAV_TAGS.items() if t == tag)
        rows = np.asarray(pcm).reshape(-1, channels)
        data, bits, width = adpcm.encode(rows, kind), 4, 4 if kind == "yamaha" else adpcm.BLOCK_BYTES
        per = 0 if kind == "yamaha" else adpcm.frames_per_block(kind, channels)
        extra = struct.pack("<H", per) if per else b""
        if kind == "ms":
            extra += struct.pack("<H", len(adpcm.MS_COEFFICIENTS)) + b"".join(struct.pack("<hh", *p) for p in adpcm.MS_COEFFICIENTS)
        extra = struct.pack("<H", len(extra)) + extra
        fact, speed = struct.pack("<4sII", b"fact", 4, frames), rate * width // per if per else rate * channels // 2
    else:
        if tag == 3:
            data, bits = np.asarray(pcm, "<f4").tobytes(), 32
        elif tag in (6, 7):
            data, bits = g711.encode(np.asarray(pcm), tag == 6).tobytes(), 8
        elif bits == 8:
            data = (np.asarray(pcm) + 128).astype(np.uint8).tobytes()
        else:
            data = _signed(pcm, bits, "<")
        width = channels * bits // 8
        speed = rate * width
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16 + len(extra), tag, channels, rate, speed, width, bits) + extra
    body = b"WAVE" + head + fact + info_list(tags or {}) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def au_bytes(pcm: np.ndarray, channels: int, rate: int, bits: int, note: str = "", form: str = "s") -> bytes:
    """An AU file of big-endian integers, floats (f) or G.711 codes (alaw, mulaw) with an annotation."""
    text = note.encode() + b"\0" * (8 - len(note.encode()) % 8)
    if form == "f":
        data, code = np.asarray(pcm, ">f4").tobytes(), 6
    elif form in ("alaw", "mulaw"):
        data, code = g711.encode(np.asarray(pcm), form == "alaw").tobytes(), 27 if form == "alaw" else 1
    else:
        data, code = _signed(pcm, bits, ">"), {8: 2, 16: 3, 24: 4, 32: 5}[bits]
    return struct.pack(">4s5I", b".snd", 24 + len(text), len(data), code, rate, channels) + text + data


def aiff_bytes(pcm: np.ndarray, channels: int, rate: int, bits: int, form: str = "NONE", tags: dict[str, str] | None = None) -> bytes:
    """An AIFF file, or AIFC where a form is named: sowt, fl32, alaw, ulaw or ima4; tags as an ID3 chunk."""
    frames = len(pcm) // channels
    if form in ("alaw", "ulaw"):
        data, bits = g711.encode(np.asarray(pcm), form == "alaw").tobytes(), 16
    elif form == "fl32":
        data, bits = np.asarray(pcm, ">f4").tobytes(), 32
    elif form == "ima4":
        data, bits = adpcm.ima4_encode(np.asarray(pcm).reshape(-1, channels)), 4
        frames = len(data) // (adpcm.IMA4_BYTES * channels)
    else:
        data = _signed(pcm, bits, "<" if form == "sowt" else ">")
    common = struct.pack(">HIH", channels, frames, bits) + to_extended(float(rate))
    if form != "NONE":
        common += form.encode() + b"\0\0"
    sound = struct.pack(">II", 0, 0) + data
    chunks = [(b"COMM", common), (b"SSND", sound)] + ([(b"ID3 ", id3v2_bytes(tags))] if tags else [])
    body = b"AIFF" if form == "NONE" else b"AIFC" + struct.pack(">4sII", b"FVER", 4, 0xA2805140)
    body += b"".join(struct.pack(">4sI", n, len(c)) + c + b"\0" * (len(c) & 1) for n, c in chunks)
    return b"FORM" + struct.pack(">I", len(body)) + body


def register(spark: SparkSession) -> None:
    """Make format "pcm" known to a session, with filter pushdown into Python sources on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PcmSource)


def to_samples(blocks: DataFrame) -> DataFrame:
    """Long form (clip_id, frame, channel, sample) of block rows."""
    out = blocks.select("clip_id", "channels", "start_frame", F.posexplode("pcm").alias("_i", "sample"))
    frame = (F.col("start_frame") + F.floor(F.col("_i") / F.col("channels"))).cast("long")
    return out.select("clip_id", frame.alias("frame"), (F.col("_i") % F.col("channels")).alias("channel"), "sample")


def to_blocks(samples: DataFrame, channels: int, rate: int, bits: int, block: int = BLOCK_FRAMES) -> DataFrame:
    """Block rows of long-form samples, whole clips in one partition and in order."""
    rows = samples if "channel" in samples.columns else samples.withColumn("channel", F.lit(0))
    at = F.floor(F.col("frame") / block).cast("long")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("frame", "channel", "sample"))), lambda s: s.sample)
    out = rows.groupBy("clip_id", at.alias("block_no")).agg(listed.alias("pcm"))
    info = [F.lit(channels).alias("channels"), F.lit(rate).alias("sample_rate"), F.lit(bits).alias("bits")]
    out = out.select("clip_id", *info, "block_no", (F.col("block_no") * block).alias("start_frame"), "pcm")
    return out.repartition("clip_id").sortWithinPartitions("clip_id", "block_no")


def clip_info(files: DataFrame) -> DataFrame:
    """Format, length and tags of files read with format binaryFile, by their headers."""
    import io

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                x = layout(io.BytesIO(content.as_py()))
                rows.append({"clip_id": os.path.basename(path), "channels": x.channels, "sample_rate": x.rate, "bits": x.out_bits, "total_frames": x.frames, "tags": list(x.tags)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("clip_id", pa.string()), ("channels", pa.int32()), ("sample_rate", pa.int32()), ("bits", pa.int32()), ("total_frames", pa.int64()), ("tags", pa.map_(pa.string(), pa.string()))]))

    return files.select("path", "content").mapInArrow(run, "clip_id string, channels int, sample_rate int, bits int, total_frames long, tags map<string,string>")
