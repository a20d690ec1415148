"""Whole clips to files and back, for every format that keeps or codes samples.

``encode_files`` gives rows (path, content) like format binaryFile, one file a
clip; ``decode_files`` tells a file's format by its magic bytes and gives
long-form samples. A task holds one batch of rows or files, and one clip whole.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelattice.operators import groups
from wavelattice.sources import alac, flac, pcm, tta, wavpack

BATCH_FRAMES, FILE_BYTES = 1 << 16, 8 << 20  # what a batch of samples or of files holds before it leaves

# Each takes samples (frames by channels), rate and bits.
WRITERS: dict[str, Callable[[np.ndarray, int, int], bytes]] = {
    "wav": lambda x, rate, bits: pcm.wav_bytes(x.reshape(-1), x.shape[1], rate, bits),
    "wav-alaw": lambda x, rate, bits: pcm.wav_bytes(x.reshape(-1), x.shape[1], rate, 16, 6),
    "wav-mulaw": lambda x, rate, bits: pcm.wav_bytes(x.reshape(-1), x.shape[1], rate, 16, 7),
    "wav-float": lambda x, rate, bits: pcm.wav_bytes(x.reshape(-1) / 2.0 ** (bits - 1), x.shape[1], rate, 32, 3),
    "wav-ima": lambda x, rate, bits: pcm.wav_bytes(x.reshape(-1), x.shape[1], rate, 16, pcm.WAV_TAGS["ima"]),
    "wav-ms": lambda x, rate, bits: pcm.wav_bytes(x.reshape(-1), x.shape[1], rate, 16, pcm.WAV_TAGS["ms"]),
    "wav-yamaha": lambda x, rate, bits: pcm.wav_bytes(x.reshape(-1), x.shape[1], rate, 16, pcm.WAV_TAGS["yamaha"]),
    "au": lambda x, rate, bits: pcm.au_bytes(x.reshape(-1), x.shape[1], rate, bits),
    "aiff": lambda x, rate, bits: pcm.aiff_bytes(x.reshape(-1), x.shape[1], rate, bits),
    "aifc-sowt": lambda x, rate, bits: pcm.aiff_bytes(x.reshape(-1), x.shape[1], rate, bits, "sowt"),
    "aifc-ima4": lambda x, rate, bits: pcm.aiff_bytes(x.reshape(-1), x.shape[1], rate, 16, "ima4"),
    "flac": lambda x, rate, bits: flac.encode(x, rate, bits),
    "tta": lambda x, rate, bits: tta.encode(x, rate),
    "alac": lambda x, rate, bits: alac.encode(x, rate, bits),
    "wavpack": lambda x, rate, bits: wavpack.encode(x, rate, bits),
}


def decode(raw: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, bits and samples (frames by channels) of a file."""
    if raw[:4] == b"fLaC":
        info, x = flac.decode(raw)
        return info.rate, info.bits, x
    if raw[:4] == b"TTA1":
        rate, x = tta.decode(raw)
        return rate, 16, x
    if raw[:4] == b"caff":
        cookie, x = alac.decode(raw)
        return cookie.rate, cookie.bits, x
    if raw[:4] == b"wvpk":
        return wavpack.decode(raw)
    shape = pcm.layout(io.BytesIO(raw))
    return shape.rate, shape.out_bits, pcm.decode(raw[shape.start : shape.start + shape.size], shape)[: shape.frames]


def encode_files(samples: DataFrame, form: str, rate: int, bits: int = 16) -> DataFrame:
    """path and content of one file a clip, from rows (clip_id, frame, sample) with or without channel."""
    write = WRITERS[form]
    rows = samples if "channel" in samples.columns else samples.withColumn("channel", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in groups.pieces(batches):
            paths, contents, size = [], [], 0
            for clip in done:
                x, channel = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in clip]) for k in ("sample", "channel"))
                paths.append(f"{clip[0].column('clip_id')[0].as_py()}.{form}")
                contents.append(write(x.astype(np.int64).reshape(-1, int(channel.max()) + 1), rate, bits))
                size += len(contents[-1])
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                    paths, contents, size = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    return groups.placed(rows.select("clip_id", "frame", "channel", "sample"), "clip_id", "frame", "channel").mapInArrow(run, "path string, content binary")


def decode_files(files: DataFrame) -> DataFrame:
    """clip_id (the file's name without its end), frame, channel, sample, sample_rate and bits of all files."""
    names = ["clip_id", "frame", "channel", "sample", "sample_rate", "bits"]

    def batch(parts: list[tuple]) -> pa.RecordBatch:
        """Parts of files (name, rate, bits, first frame, samples) as one batch."""
        clips, rates, widths, firsts, xs = zip(*parts, strict=True)
        sizes = [x.size for x in xs]
        columns = [
            pa.array(clips, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), sizes))),
            np.concatenate([np.repeat(np.arange(a, a + len(x)), x.shape[1]) for a, x in zip(firsts, xs, strict=True)]),
            np.concatenate([np.tile(np.arange(x.shape[1], dtype=np.int32), len(x)) for x in xs]),
            np.concatenate([x.reshape(-1).astype(np.int32) for x in xs]),
            np.repeat(np.array(rates, np.int32), sizes),
            np.repeat(np.array(widths, np.int32), sizes),
        ]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rate, bits, x = decode(content.as_py())
                name = os.path.basename(path).rsplit(".", 1)[0]
                for a in range(0, len(x), BATCH_FRAMES):
                    parts.append((name, rate, bits, a, x[a : a + BATCH_FRAMES]))
                    size += parts[-1][-1].size
                    if size >= BATCH_FRAMES:
                        yield batch(parts)
                        parts, size = [], 0
        if parts:
            yield batch(parts)

    return files.select("path", "content").mapInArrow(run, "clip_id string, frame long, channel int, sample int, sample_rate int, bits int")


def decode_floats(files: DataFrame) -> DataFrame:
    """Samples of all files as parts of full scale (value), with clip_id, frame, channel and sample_rate."""
    full = F.pow(F.lit(2.0), F.col("bits") - 1) - 1
    return decode_files(files).select("clip_id", "frame", "channel", (F.col("sample") / full).cast("float").alias("value"), "sample_rate")


def for_each_block(files: DataFrame, call: Callable[[str, int, np.ndarray], None], block: int = 4096) -> None:
    """Call ``call`` with name, first frame and samples (frames by channels) of every block, where the file lies."""

    def run(rows: Iterator) -> None:
        for r in rows:
            _, _, x = decode(bytes(r.content))
            for a in range(0, len(x), block):
                call(os.path.basename(r.path), a, x[a : a + block])

    files.select("path", "content").foreachPartition(run)


class Incremental:
    """An encoder that takes samples as they come: ``push`` and ``finish`` give the bytes that are ready."""

    def push(self, samples: np.ndarray) -> bytes:
        raise NotImplementedError

    def finish(self) -> bytes:
        return b""


class FlacStream(Incremental):
    """A FLAC stream of unknown length: the header comes first, without total and digest, then each block once it is full."""

    def __init__(self, rate: int, channels: int, bits: int = 16, block: int = 4096):
        self.bits, self.block, self.number = bits, block, 0
        self.head = flac.stream_header(rate, channels, bits, 0, bytes(16), block)
        self.held = np.zeros((0, channels), np.int64)

    def push(self, samples: np.ndarray) -> bytes:
        self.held = np.concatenate([self.held, samples])
        out, self.head = self.head, b""
        while len(self.held) >= self.block:
            out += self._one(self.block)
        return out

    def finish(self) -> bytes:
        return self.head + (self._one(len(self.held)) if len(self.held) else b"")

    def _one(self, n: int) -> bytes:
        out = flac.encode_block(self.held[:n], self.bits, self.number)
        self.held, self.number = self.held[n:], self.number + 1
        return out


class PacketStream(Incremental):
    """Packets of a codec whose blocks stand alone (ALAC packets, TTA frames, WavPack blocks), each once it is full."""

    def __init__(self, encode: Callable[[np.ndarray], bytes], channels: int, block: int):
        self.encode, self.block, self.held = encode, block, np.zeros((0, channels), np.int64)

    def push(self, samples: np.ndarray) -> bytes:
        self.held = np.concatenate([self.held, samples])
        out = b""
        while len(self.held) >= self.block:
            out += self.encode(self.held[: self.block])
            self.held = self.held[self.block :]
        return out

    def finish(self) -> bytes:
        return self.encode(self.held) if len(self.held) else b""
