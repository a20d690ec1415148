"""Loudness normalisation with a true-peak limiter, clip by clip on float samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelattice.operators.analysis import integrated_loudness

REACH, PASSES = 24, 4


def _kernel() -> np.ndarray:
    x = np.arange(2 * REACH)[None, :] - REACH + 1 - (np.arange(4) / 4)[:, None]
    beta = 0.1102 * (80 - 8.7)
    rows = np.sinc(x) * np.i0(beta * np.sqrt(np.clip(1 - (x / REACH) ** 2, 0, None))) / np.i0(beta)
    return rows / rows.sum(axis=1, keepdims=True)


def frame_peaks(x: np.ndarray) -> np.ndarray:
    """Largest fourfold oversampled size between each frame and the next, over channels."""
    out = np.abs(x).max(axis=1)
    for channel in x.T:
        padded = np.concatenate([np.zeros(REACH - 1), channel, np.zeros(REACH)])
        for row in _kernel()[1:]:
            np.maximum(out, np.abs(np.convolve(padded, row[::-1], "valid")), out=out)
    return out


def _sliding_min(x: np.ndarray, before: int, after: int) -> np.ndarray:
    padded = np.concatenate([np.ones(before), x, np.ones(after)])
    return np.lib.stride_tricks.sliding_window_view(padded, before + after + 1).min(axis=1)


def limited(x: np.ndarray, rate: int, ceiling: float) -> np.ndarray:
    """Frames by channels with true peaks at or below ``ceiling``."""
    ahead = max(1, round(0.005 * rate))
    release = 1 - math.exp(-1 / (0.1 * rate))
    for _ in range(PASSES):
        peaks = frame_peaks(x)
        if peaks.max(initial=0) <= ceiling:
            return x
        need = np.minimum(1.0, ceiling / np.maximum(peaks, 1e-12))
        need = _sliding_min(_sliding_min(need, REACH, REACH), 0, ahead)
        smooth = np.convolve(np.concatenate([np.full(ahead, need[0]), need]), np.ones(ahead + 1) / (ahead + 1), "valid")
        gain, g = np.empty(len(smooth)), 1.0
        for i, s in enumerate(smooth.tolist()):
            g = min(s, g + (1 - g) * release)
            gain[i] = g
        x = x * gain[:, None]
    top = frame_peaks(x).max(initial=0)
    return x * (ceiling / top * (1 - 1e-6)) if top > ceiling else x


def normalize(samples: DataFrame, rate: int, target_lufs: float, ceiling_db: float) -> DataFrame:
    """Float clips (clip_id, frame, channel, sample) at a loudness, their true peaks limited.

    Clips without a finite loudness are left as they are.
    """
    gains = integrated_loudness(samples, rate, None, partial=False)
    gains = gains.select("clip_id", F.when(F.col("lufs") > float("-inf"), F.pow(F.lit(10.0), (F.lit(target_lufs) - F.col("lufs")) / 20)).alias("gain"))
    ceiling = 10 ** (ceiling_db / 20)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["gain"].iloc[0]
        if g is None or math.isnan(g):
            return pdf[["clip_id", "frame", "channel", "sample"]]
        wide = pdf.pivot(index="frame", columns="channel", values="sample").sort_index()
        y = limited(wide.to_numpy(np.float64) * np.float32(g), rate, ceiling)
        n, c = y.shape
        return pd.DataFrame({"clip_id": pdf["clip_id"].iloc[0], "frame": np.repeat(wide.index.to_numpy(), c), "channel": np.tile(np.asarray(wide.columns), n), "sample": y.reshape(-1)})

    return samples.join(gains, "clip_id").groupBy("clip_id").applyInPandas(run, "clip_id string, frame long, channel int, sample double")
