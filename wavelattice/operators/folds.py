"""Recurrences: filters and dynamics whose state runs through a clip.

Each clip (and channel where channels are independent) is one task's group,
ordered by frame and folded in numpy; the parallelism is the number of clips
and the memory that of the longest one. State starts at zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wavelattice.operators.analysis import filtered
from wavelattice.operators.format import native_range


def fold(samples: DataFrame, f: Callable[[np.ndarray], np.ndarray], by_channel: bool = True) -> DataFrame:
    """Apply ``f`` to each clip's samples in frame order.

    With channels that are linked, ``f`` gets frames by channels; else one
    channel as a vector. It returns integers of the same or a greater length.
    """
    channel = "channel" in samples.columns
    keys = ["clip_id", "channel"] if channel and by_channel else ["clip_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if channel and not by_channel:
            wide = pdf.pivot(index="frame", columns="channel", values="sample").sort_index()
            y = f(wide.to_numpy(np.float64))
            n, c = y.shape
            return pd.DataFrame({"clip_id": pdf["clip_id"].iloc[0], "frame": np.repeat(np.arange(n), c), "channel": np.tile(np.asarray(wide.columns), n), "sample": y.reshape(-1)})
        y = f(pdf.sort_values("frame")["sample"].to_numpy(np.float64))
        out = {"clip_id": pdf["clip_id"].iloc[0], "frame": np.arange(len(y)), "sample": y}
        if channel:
            out["channel"] = pdf["channel"].iloc[0]
        return pd.DataFrame(out)[["clip_id", "frame", *(["channel"] if channel else []), "sample"]]

    schema = "clip_id string, frame long, " + ("channel int, " if channel else "") + "sample int"
    return samples.groupBy(*keys).applyInPandas(run, schema)


def _rounded(y: np.ndarray, bits: int) -> np.ndarray:
    lo, hi = native_range(bits)
    return np.clip(np.rint(y), lo, hi).astype(np.int64)


def _cut(y: np.ndarray, lo: float, hi: float) -> np.ndarray:
    return np.trunc(np.clip(y, lo, hi)).astype(np.int64)


def biquad_coefficients(kind: str, rate: int, frequency: float, q: float = 0.7071, gain_db: float = 0.0) -> tuple[float, float, float, float, float]:
    """(b0, b1, b2, a1, a2) of the cookbook filters, divided by a0."""
    if not 0 < frequency < rate / 2:
        raise ValueError("the frequency must lie between 0 and half the sample rate")
    if q <= 0:
        raise ValueError("q must be positive")
    w0 = 2 * math.pi * frequency / rate
    cos, sin, a = math.cos(w0), math.sin(w0), 10 ** (gain_db / 40)
    alpha = sin / (2 * q)
    if kind in ("low_shelf", "high_shelf"):
        slope = min(q, 1.0)
        alpha = sin / 2 * math.sqrt((a + 1 / a) * (1 / slope - 1) + 2)
        s, r = (1 if kind == "low_shelf" else -1), 2 * math.sqrt(a) * alpha
        b = (a * ((a + 1) - s * (a - 1) * cos + r), s * 2 * a * ((a - 1) - s * (a + 1) * cos), a * ((a + 1) - s * (a - 1) * cos - r))
        d = ((a + 1) + s * (a - 1) * cos + r, -s * 2 * ((a - 1) + s * (a + 1) * cos), (a + 1) + s * (a - 1) * cos - r)
    else:
        d = (1 + alpha, -2 * cos, 1 - alpha)
        forms = {
            "low_pass": ((1 - cos) / 2, 1 - cos, (1 - cos) / 2),
            "high_pass": ((1 + cos) / 2, -(1 + cos), (1 + cos) / 2),
            "band_pass": (alpha, 0.0, -alpha),
            "notch": (1.0, -2 * cos, 1.0),
            "all_pass": (1 - alpha, -2 * cos, 1 + alpha),
            "peaking": (1 + alpha * a, -2 * cos, 1 - alpha * a),
        }
        if kind not in forms:
            raise ValueError(f"unknown filter {kind}")
        b = forms[kind]
        if kind == "peaking":
            d = (1 + alpha / a, -2 * cos, 1 - alpha / a)
    return b[0] / d[0], b[1] / d[0], b[2] / d[0], d[1] / d[0], d[2] / d[0]


def biquad(samples: DataFrame, kind: str, rate: int, frequency: float, q: float, bits: int, gain_db: float = 0.0) -> DataFrame:
    c = biquad_coefficients(kind, rate, frequency, q, gain_db)
    return fold(samples, lambda x: _rounded(filtered(x, *c), bits))


def butterworth_stages(kind: str, order: int, rate: int, frequency: float) -> list[tuple[float, ...]]:
    if order < 2 or order > 64 or order % 2:
        raise ValueError("the order must be even, from 2 to 64")
    return [biquad_coefficients(kind, rate, frequency, 1 / (2 * math.cos((2 * k - 1) * math.pi / (2 * order)))) for k in range(1, order // 2 + 1)]


def butterworth(samples: DataFrame, kind: str, order: int, rate: int, frequency: float, bits: int) -> DataFrame:
    """Cascaded biquads, rounded to integers between stages."""
    stages = butterworth_stages(kind, order, rate, frequency)

    def run(x: np.ndarray) -> np.ndarray:
        for c in stages:
            x = _rounded(filtered(x, *c), bits).astype(np.float64)
        return x.astype(np.int64)

    return fold(samples, run)


def time_constant(rate: int, ms: float) -> float:
    return math.exp(-1 / (rate * ms / 1000)) if ms > 0 else 0.0


def envelope(peak: np.ndarray, attack: float, release: float) -> np.ndarray:
    """One-pole peak follower."""
    out, e = np.empty(len(peak)), 0.0
    for i, p in enumerate(peak.tolist()):
        c = attack if p > e else release
        e = c * e + (1 - c) * p
        out[i] = e
    return out


def _dynamics(samples: DataFrame, bits: int, attack: float, release: float, gains: Callable, lo: float, hi: float) -> DataFrame:
    def run(x: np.ndarray) -> np.ndarray:
        linked = x if x.ndim == 2 else x[:, None]
        e = envelope(np.abs(linked).max(axis=1), attack, release)
        y = _cut(linked * gains(e)[:, None], lo, hi)
        return y if x.ndim == 2 else y[:, 0]

    return fold(samples, run, by_channel=False)


def _db(e: np.ndarray, hi: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(e > 0, 20 * np.log10(np.where(e > 0, e, 1) / hi), -np.inf)


def compressor(samples: DataFrame, rate: int, threshold_db: float, ratio: float, attack_ms: float, release_ms: float, makeup_db: float, bits: int) -> DataFrame:
    if ratio < 1:
        raise ValueError("the ratio must be 1 at least")
    lo, hi = native_range(bits)

    def gains(e: np.ndarray) -> np.ndarray:
        over = _db(e, hi) - threshold_db
        return 10 ** ((makeup_db - np.where(over > 0, over * (1 - 1 / ratio), 0)) / 20)

    return _dynamics(samples, bits, time_constant(rate, attack_ms), time_constant(rate, release_ms), gains, lo, hi)


def noise_gate(samples: DataFrame, rate: int, threshold_db: float, ratio: float, attack_ms: float, release_ms: float, bits: int) -> DataFrame:
    """Downward expander below the threshold."""
    if ratio < 1:
        raise ValueError("the ratio must be 1 at least")
    lo, hi = native_range(bits)

    def gains(e: np.ndarray) -> np.ndarray:
        under = threshold_db - _db(e, hi)
        return 10 ** (-np.where(under > 0, under * (1 - 1 / ratio) if ratio > 1 else 0, 0) / 20)

    return _dynamics(samples, bits, time_constant(rate, attack_ms), time_constant(rate, release_ms), gains, lo, hi)


def limiter(samples: DataFrame, rate: int, ceiling_db: float, release_ms: float, attack_ms: float, bits: int) -> DataFrame:
    lo, hi = native_range(bits)
    top = 10 ** (ceiling_db / 20) * hi
    gains = lambda e: np.where(e > top, top / np.where(e > 0, e, 1), 1.0)
    return _dynamics(samples, bits, time_constant(rate, attack_ms), time_constant(rate, release_ms), gains, max(lo, -top), min(hi, top))


def echo(samples: DataFrame, rate: int, delay_s: float, feedback: float, wet: float, bits: int) -> DataFrame:
    """Echo with feedback; the tail rings out after the clip."""
    if not 0 <= feedback < 1:
        raise ValueError("feedback must lie between 0 and 1")
    lo, hi = native_range(bits)
    d = max(1, round(delay_s * rate))
    tail = min(30 * rate, math.ceil(math.log(0.001) / math.log(feedback)) * d) if feedback > 0 else 0

    def run(x: np.ndarray) -> np.ndarray:
        x = np.concatenate([x, np.zeros(tail)])
        y, line = np.empty(len(x), np.int64), np.zeros(d)
        # The frames of one turn of the line do not depend on each other.
        for a in range(0, len(x), d):
            part = x[a : a + d]
            late = line[: len(part)]
            y[a : a + d] = _cut(part + wet * late, lo, hi)
            line[: len(part)] = _cut(part + feedback * late, lo, hi)
        return y

    return fold(samples, run)


@dataclass(frozen=True)
class DuckSettings:
    """A sidechain compressor: levels as parts of full scale, times in milliseconds."""

    threshold: float = 0.125
    ratio: float = 2.0
    attack_ms: float = 20.0
    release_ms: float = 250.0
    knee: float = 2.82843
    makeup: float = 1.0
    key_gain: float = 1.0
    mix: float = 1.0
    rms: bool = True


def duck_gains(key: np.ndarray, rate: int, s: DuckSettings) -> np.ndarray:
    """Gain for each frame of a mono key signal."""
    attack, release = (min(1.0, 4000.0 / (ms * rate)) for ms in (s.attack_ms, s.release_ms))
    log_t = math.log(s.threshold)
    lin_start, log_start, log_stop = s.threshold / math.sqrt(s.knee), log_t - math.log(s.knee) / 2, log_t + math.log(s.knee) / 2
    floor = lin_start**2 if s.rms else lin_start
    out_stop = (log_stop - log_t) / s.ratio + log_t
    gains, level = np.ones(len(key)), 0.0
    for i, k in enumerate((np.abs(key) * s.key_gain).tolist()):
        k = k * k if s.rms else k
        level += (k - level) * (attack if k > level else release)
        if level <= floor or level <= 0:
            continue
        slope = math.log(level) * (0.5 if s.rms else 1.0)
        if s.knee > 1 and slope < log_stop:
            # Cubic Hermite between the slopes 1 and 1 / ratio.
            width = log_stop - log_start
            t = (slope - log_start) / width
            m0, m1 = width, width / s.ratio
            out = (2 * t**3 - 3 * t**2 + 1) * log_start + (t**3 - 2 * t**2 + t) * m0 + (-2 * t**3 + 3 * t**2) * out_stop + (t**3 - t**2) * m1
        else:
            out = (slope - log_t) / s.ratio + log_t
        gains[i] = math.exp(out - slope)
    return gains


def duck(target: DataFrame, key: DataFrame, rate: int, settings: DuckSettings) -> DataFrame:
    """Float clips lowered while their key (same clip_id and frame, missing is silent) is loud."""
    from pyspark.sql import functions as F

    both = target.join(key.select("clip_id", "frame", F.col("sample").alias("key")), ["clip_id", "frame"], "left").fillna(0.0, ["key"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        g = duck_gains(pdf["key"].to_numpy(np.float64), rate, settings)
        y = pdf["sample"].to_numpy(np.float64) * (g * settings.makeup * settings.mix + 1 - settings.mix)
        return pd.DataFrame({"clip_id": pdf["clip_id"], "frame": pdf["frame"], "sample": y.astype(np.float32)})

    return both.groupBy("clip_id").applyInPandas(run, "clip_id string, frame long, sample float")
