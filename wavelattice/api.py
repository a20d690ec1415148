"""File-level verbs: probe, convert, cut, mix and concatenate PCM files through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.operators import align, analysis
from wavelattice.operators.format import Format
from wavelattice.operators.pipeline import Fade, Pipeline, Transform
from wavelattice.sources import pcm


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, Format]:
    """Samples of the files at a path and the one format they share."""
    pcm.register(spark)
    blocks = spark.read.format("pcm").option("path", path).load()
    formats = blocks.select("channels", "sample_rate", "bits").distinct().limit(2).collect()
    if len(formats) != 1:
        raise ValueError("the files need audio of one format")
    return pcm.to_samples(blocks), Format(*formats[0])


def _save(samples: DataFrame, fmt: Format, path: str) -> None:
    pcm.to_blocks(samples, fmt.channels, fmt.sample_rate, fmt.bits).write.format("pcm").mode("append").save(path)


def probe(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: format, length, peak, RMS, loudness, waveform and tags."""
    samples, fmt = _open(spark, path)
    info = pcm.clip_info(spark.read.format("binaryFile").load(path)).withColumn("duration_s", F.col("total_frames") / F.col("sample_rate"))
    out = info.join(analysis.levels(samples, fmt.bits).select("clip_id", "peak", "rms"), "clip_id", "left")
    out = out.join(analysis.integrated_loudness(samples, fmt.sample_rate, fmt.bits), "clip_id", "left")
    return out.join(analysis.waveform_array(samples, fmt.bits), "clip_id", "left")


def convert(spark: SparkSession, path: str, out: str, *transforms: Transform) -> Format:
    """Write every file at ``path`` through the transforms as WAV below ``out``."""
    samples, fmt = _open(spark, path)
    chain = Pipeline(list(transforms))
    _save(chain.apply(samples, fmt), chain.format(fmt), out)
    return chain.format(fmt)


def cut(spark: SparkSession, path: str, out: str, start_s: int, end_s: int, *transforms: Transform, fade_in: float = 0.0, fade_out: float = 0.0) -> bool:
    """Write the seconds [start, end) of every file; the fade comes before the transforms. False if none is left."""
    samples, fmt = _open(spark, path)
    part = align.cut(samples, start_s, end_s, fmt.sample_rate)
    if part.isEmpty():
        return False
    chain = Pipeline([Fade(fade_in, fade_out), *transforms])
    _save(chain.apply(part, fmt), chain.format(fmt), out)
    return True


def mix(spark: SparkSession, inputs: list[tuple[str, float]], out: str, name: str) -> None:
    """One file of the sum of files with gains, all of one format."""
    opened = [(*_open(spark, p), g) for p, g in inputs]
    if len({fmt for _, fmt, _ in opened}) != 1:
        raise ValueError("the inputs need one format")
    rows = [(s.withColumn("clip_id", F.lit(name)), g) for s, _, g in opened]
    _save(align.mix(rows, opened[0][1].bits), opened[0][1], out)


def concatenate(spark: SparkSession, paths: list[str], out: str, name: str) -> None:
    """One file of all files in order, all of one format."""
    opened = [_open(spark, p) for p in paths]
    if len({fmt for _, fmt in opened}) != 1:
        raise ValueError("the inputs need one format")
    _save(align.concat([s for s, _ in opened], name), opened[0][1], out)
