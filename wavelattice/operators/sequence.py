"""Operators over the order of a clip's frames that need no recurrence.

Windows are partitioned by clip (and channel). A clip's frames are sorted once
and all operators of a chain reuse that order.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.operators.format import native_range
from wavelattice.operators.pointwise import rounded, truncated


def by_clip(samples: DataFrame) -> Window:
    return Window.partitionBy(*[k for k in ("clip_id", "channel") if k in samples.columns]).orderBy("frame")


SHORT_KERNEL = 32


def fir(samples: DataFrame, taps: list[float], bits: int) -> DataFrame:
    """Convolution with a kernel, history zero, rounded half to even.

    Kernels of up to SHORT_KERNEL taps are a sum of lags in the order of the
    taps; longer ones are convolved clip by clip.
    """
    if not taps:
        raise ValueError("a kernel needs a tap")
    if len(taps) > SHORT_KERNEL:
        return _long_fir(samples, np.asarray(taps, np.float64), bits)
    w = by_clip(samples)
    total = None
    for k, tap in enumerate(taps):
        term = (F.coalesce(F.lag("sample", k).over(w), F.lit(0)) if k else F.col("sample")).cast("double") * tap
        total = term if total is None else total + term
    return samples.withColumn("sample", rounded(total, bits))


def _long_fir(samples: DataFrame, taps: np.ndarray, bits: int) -> DataFrame:
    lo, hi = native_range(bits)
    by = [k for k in ("clip_id", "channel") if k in samples.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        y = np.convolve(pdf["sample"].to_numpy(np.float64), taps)[: len(pdf)]
        pdf["sample"] = np.clip(np.rint(np.nan_to_num(y)), lo, hi).astype(np.int32)
        return pdf

    rows = samples.select(*by, "frame", "sample")
    return rows.groupBy(*by).applyInPandas(run, rows.schema)


def sliding(samples: DataFrame, before: int, after: int, kind: str) -> DataFrame:
    """Smallest or largest sample from ``before`` frames back to ``after`` ahead."""
    if before < 0 or after < 0:
        raise ValueError("the window must not be negative")
    f = {"min": F.min, "max": F.max}[kind]
    return samples.withColumn("sample", f("sample").over(by_clip(samples).rowsBetween(-before, after)))


def echo_dry(samples: DataFrame, delay: int, wet: float, bits: int) -> DataFrame:
    """One echo without feedback."""
    if delay < 1:
        raise ValueError("the delay must be a frame at least")
    late = F.coalesce(F.lag("sample", delay).over(by_clip(samples)), F.lit(0))
    return samples.withColumn("sample", truncated(F.col("sample").cast("double") + late.cast("double") * wet, bits))


@functools.lru_cache(maxsize=8)
def kaiser_kernel(ratio: float, half_width: int = 32, phases: int = 1024) -> tuple[np.ndarray, int]:
    """Normalised rows of a windowed sinc for each phase, and its half width at this ratio."""
    cutoff = min(1.0, ratio)
    hw = min(256, math.ceil(half_width / cutoff)) if cutoff < 1 else half_width
    beta = 0.1102 * (80 - 8.7)
    x = np.arange(2 * hw)[None, :] - hw + 1 - (np.arange(phases) / phases)[:, None]
    sinc = cutoff * np.sinc(x * cutoff)
    inside = np.clip(1 - (x / hw) ** 2, 0, None)
    rows = sinc * np.i0(beta * np.sqrt(inside)) / np.i0(beta) * (np.abs(x) <= hw)
    return rows / rows.sum(axis=1, keepdims=True), hw


def resampled(x: np.ndarray, ratio: float, half_width: int = 32, accumulate: bool = True) -> np.ndarray:
    """Polyphase resampling to round(n * ratio) values; indices beyond the ends repeat them."""
    kernel, hw = kaiser_kernel(ratio, half_width)
    n = int(round(len(x) * ratio))
    if not len(x) or not n:
        return np.zeros(0)
    step = 1 / ratio
    at = np.concatenate(([0.0], np.cumsum(np.full(n - 1, step)))) if accumulate else np.arange(n) * step
    base = np.floor(at).astype(np.int64)
    phase = np.minimum(len(kernel) - 1, np.rint((at - base) * len(kernel)).astype(np.int64))
    out = np.empty(n)
    for a in range(0, n, 8192):
        rows = slice(a, a + 8192)
        index = np.clip(base[rows, None] + np.arange(2 * hw)[None, :] - hw + 1, 0, len(x) - 1)
        out[rows] = (x[index] * kernel[phase[rows]]).sum(axis=1)
    return out


def resample(samples: DataFrame, source_rate: int, target_rate: int, half_width: int = 32) -> DataFrame:
    """Each clip at another sample rate; integers rounded half to even."""
    if source_rate == target_rate:
        return samples
    ratio = target_rate / source_rate
    by = [k for k in ("clip_id", "channel") if k in samples.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        y = resampled(pdf["sample"].to_numpy(np.float64), ratio, half_width)
        y = np.clip(np.rint(y), -(2**31), 2**31 - 1).astype(np.int32)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, "frame": np.arange(len(y)), "sample": y})[[*by, "frame", "sample"]]

    schema = ", ".join([f"{k} {'string' if k == 'clip_id' else 'int'}" for k in by] + ["frame long", "sample int"])
    return samples.groupBy(*by).applyInPandas(run, schema)


SPEECH_RATE = 16_000


def resample_float(values: DataFrame, source_rate: int, target_rate: int, half_width: int = 32) -> DataFrame:
    """Float clips (clip_id, frame, value, with or without channel) at another rate."""
    if source_rate == target_rate:
        return values
    ratio = target_rate / source_rate
    by = [k for k in ("clip_id", "channel") if k in values.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = resampled(pdf.sort_values("frame")["value"].to_numpy(np.float64), ratio, half_width, accumulate=False)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, "frame": np.arange(len(y)), "value": y.astype(np.float32)})[[*by, "frame", "value"]]

    schema = ", ".join([f"{k} {'string' if k == 'clip_id' else 'int'}" for k in by] + ["frame long", "value float"])
    return values.groupBy(*by).applyInPandas(run, schema)


def downmix_for_speech(values: DataFrame, channels: int, rate: int) -> DataFrame:
    """The mean of all channels at 16 kHz."""
    mono = values
    if channels > 1:
        mono = values.groupBy("clip_id", "frame").agg((F.sum(F.col("value").cast("double")) / channels).cast("float").alias("value"))
    return resample_float(mono, rate, SPEECH_RATE)


def oversampling_rows(half_width: int = 24) -> np.ndarray:
    """Taps of the four phases of the true-peak oversampler, in single precision."""
    x = np.arange(2 * half_width)[None, :] - half_width + 1 - (np.arange(4) / 4)[:, None]
    beta = 0.1102 * (80 - 8.7)
    rows = np.sinc(x) * np.i0(beta * np.sqrt(np.clip(1 - (x / half_width) ** 2, 0, None))) / np.i0(beta)
    return (rows / rows.sum(axis=1, keepdims=True)).astype(np.float32).astype(np.float64)


def true_peak(samples: DataFrame, half_width: int = 24) -> DataFrame:
    """Largest absolute value of each clip's fourfold oversampled float signal, in dB (minus infinity if silent)."""
    rows = oversampling_rows(half_width)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("frame")["sample"].to_numpy(np.float32).astype(np.float64)
        padded = np.concatenate([np.zeros(half_width - 1), v, np.zeros(half_width)])
        peak = float(np.abs(v).max(initial=0))
        for row in rows[1:]:
            peak = max(peak, float(np.abs(np.convolve(padded, row[::-1], "valid")).max(initial=0)))
        return pd.DataFrame({"clip_id": [pdf["clip_id"].iloc[0]], "peak_db": [20 * math.log10(peak) if peak > 0 else float("-inf")]})

    by_channel = samples.groupBy("clip_id", *(["channel"] if "channel" in samples.columns else []))
    return by_channel.applyInPandas(run, "clip_id string, peak_db double").groupBy("clip_id").agg(F.max("peak_db").alias("peak_db"))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    """sum x[t] cos(pi / n (t + 1/2 + n/2)(k + 1/2)) over t, for the n first k, by one Fourier transform of 2n values."""
    shift, t = 0.5 + n / 2, np.arange(2 * n)
    spectrum = np.fft.fft(x * np.exp(-1j * np.pi * t / (2 * n)))[:n]
    return (spectrum * np.exp(-1j * np.pi * shift * (np.arange(n) + 0.5) / n)).real


def _unturned(c: np.ndarray, n: int) -> np.ndarray:
    """sum c[k] cos(pi / n (t + 1/2 + n/2)(k + 1/2)) over k, for 2n t."""
    shift, k = 0.5 + n / 2, np.arange(n)
    spectrum = np.fft.fft(np.concatenate([c * np.exp(-1j * np.pi * shift * k / n), np.zeros(n)]))
    return (spectrum * np.exp(-1j * np.pi * (np.arange(2 * n) + shift) / (2 * n))).real


def mdct(clips: DataFrame, column: str) -> DataFrame:
    """Forward MDCT of an array column of 2N values: N coefficients."""

    @F.pandas_udf("array<double>")
    def transform(s: pd.Series) -> pd.Series:
        def one(v) -> np.ndarray:
            if len(v) % 2:
                raise ValueError("the number of values must be even")
            return _turned(np.asarray(v, np.float64), len(v) // 2)

        return s.map(one)

    return clips.withColumn("mdct", transform(column))


def imdct(clips: DataFrame, column: str) -> DataFrame:
    """Inverse MDCT of an array column of N coefficients: 2N values, divided by N; overlapped halves add up to the input."""

    @F.pandas_udf("array<double>")
    def transform(s: pd.Series) -> pd.Series:
        return s.map(lambda v: _unturned(np.asarray(v, np.float64), len(v)) / max(len(v), 1))

    return clips.withColumn("imdct", transform(column))
