"""Chains of transforms over samples, with the format carried along.

A transform takes samples and their Format and returns both. A pipeline
applies its transforms in order; those that change nothing are left out when
the plan is built, and the output format is known without running anything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelattice.operators import analysis, folds, sequence
from wavelattice.operators import pointwise as pw
from wavelattice.operators.format import Format


class Transform:
    """Base of all transforms; subclasses override what differs."""

    def format(self, fmt: Format) -> Format:
        return fmt

    def is_identity(self, fmt: Format) -> bool:
        return False

    def apply(self, samples: DataFrame, fmt: Format) -> DataFrame:
        raise NotImplementedError


@dataclass
class Column(Transform):
    """A transform of the sample column alone: f(sample, format)."""

    f: Callable

    def apply(self, samples, fmt):
        return samples.withColumn("sample", self.f(F.col("sample"), fmt))


@dataclass
class Gain(Transform):
    gain: float

    def is_identity(self, fmt):
        return self.gain == 1

    def apply(self, samples, fmt):
        return samples.withColumn("sample", pw.gain(F.col("sample"), self.gain, fmt.bits))


@dataclass
class Pan(Transform):
    position: float
    law: str = "linear"

    def is_identity(self, fmt):
        return pw.pan_gains(self.position, self.law) == (1.0, 1.0)

    def apply(self, samples, fmt):
        if fmt.channels != 2:
            raise ValueError("pan needs two channels")
        return samples.withColumn("sample", pw.pan(F.col("sample"), F.col("channel"), self.position, fmt.bits, self.law))


@dataclass
class BitDepth(Transform):
    bits: int

    def is_identity(self, fmt):
        return self.bits == fmt.bits

    def format(self, fmt):
        return fmt.with_(bits=self.bits)

    def apply(self, samples, fmt):
        return samples.withColumn("sample", pw.rescale_bits(F.col("sample"), fmt.bits, self.bits))


@dataclass
class Channels(Transform):
    channels: int

    def is_identity(self, fmt):
        return self.channels == fmt.channels

    def format(self, fmt):
        return fmt.with_(channels=self.channels)

    def apply(self, samples, fmt):
        return pw.remix(samples, fmt.channels, self.channels)


@dataclass
class Fade(Transform):
    """Fades in seconds, relative to each clip's length."""

    fade_in: float = 0.0
    fade_out: float = 0.0
    curve: str = "linear"

    def is_identity(self, fmt):
        return not self.fade_in and not self.fade_out

    def apply(self, samples, fmt):
        total = samples.groupBy("clip_id").agg((F.max("frame") + 1).alias("_total"))
        a, b = (round(s * fmt.sample_rate) for s in (self.fade_in, self.fade_out))
        return samples.join(total, "clip_id").withColumn("sample", pw.fade(F.col("sample"), F.col("frame"), F.col("_total"), a, b, self.curve)).drop("_total")


@dataclass
class PeakNormalize(Transform):
    target_db: float

    def apply(self, samples, fmt):
        return analysis.peak_normalize(samples, self.target_db, fmt.bits)


@dataclass
class Loudness(Transform):
    target_lufs: float

    def apply(self, samples, fmt):
        return analysis.loudness_normalize(samples, self.target_lufs, fmt.sample_rate, fmt.bits)


@dataclass
class Resample(Transform):
    sample_rate: int

    def is_identity(self, fmt):
        return self.sample_rate == fmt.sample_rate

    def format(self, fmt):
        return fmt.with_(sample_rate=self.sample_rate)

    def apply(self, samples, fmt):
        return sequence.resample(samples, fmt.sample_rate, self.sample_rate)


@dataclass
class Biquad(Transform):
    kind: str
    frequency: float
    q: float = 0.7071
    gain_db: float = 0.0

    def apply(self, samples, fmt):
        return folds.biquad(samples, self.kind, fmt.sample_rate, self.frequency, self.q, fmt.bits, self.gain_db)


@dataclass
class Fir(Transform):
    taps: list[float]

    def apply(self, samples, fmt):
        return sequence.fir(samples, self.taps, fmt.bits)


@dataclass
class Compressor(Transform):
    threshold_db: float
    ratio: float
    attack_ms: float = 5.0
    release_ms: float = 50.0
    makeup_db: float = 0.0

    def apply(self, samples, fmt):
        return folds.compressor(samples, fmt.sample_rate, self.threshold_db, self.ratio, self.attack_ms, self.release_ms, self.makeup_db, fmt.bits)


@dataclass
class Limiter(Transform):
    ceiling_db: float
    release_ms: float = 50.0
    attack_ms: float = 0.0

    def apply(self, samples, fmt):
        return folds.limiter(samples, fmt.sample_rate, self.ceiling_db, self.release_ms, self.attack_ms, fmt.bits)


@dataclass
class Echo(Transform):
    delay_s: float
    feedback: float
    wet: float

    def apply(self, samples, fmt):
        if not self.feedback:
            return sequence.echo_dry(samples, max(1, round(self.delay_s * fmt.sample_rate)), self.wet, fmt.bits)
        return folds.echo(samples, fmt.sample_rate, self.delay_s, self.feedback, self.wet, fmt.bits)


@dataclass
class Pipeline(Transform):
    transforms: list[Transform] = field(default_factory=list)

    def format(self, fmt):
        for t in self.transforms:
            fmt = t.format(fmt)
        return fmt

    def is_identity(self, fmt):
        return all(t.is_identity(fmt) for t in self.transforms)

    def apply(self, samples, fmt):
        for t in self.transforms:
            if not t.is_identity(fmt):
                samples = t.apply(samples, fmt)
            fmt = t.format(fmt)
        return samples
