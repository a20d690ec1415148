"""Level, waveform and loudness analysis of clips.

Everything is grouped by clip_id; the aggregations combine before the shuffle.
Only K-weighting is a recurrence and runs clip by clip in numpy.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.operators.format import native_range
from wavelattice.operators.pointwise import truncated


def _size() -> Column:
    return F.abs(F.col("sample").cast("long"))


def levels(samples: DataFrame, bits: int) -> DataFrame:
    """Frames, peak and root mean square of each clip, as parts of full scale."""
    full, x = float(1 << (bits - 1)), F.col("sample").cast("double")
    return samples.groupBy("clip_id").agg(
        F.count_distinct("frame").alias("total_frames") if "channel" in samples.columns else F.count("*").alias("total_frames"),
        (F.max(_size()) / full).alias("peak"),
        (F.sqrt(F.sum(x * x) / F.count("*")) / full).alias("rms"),
    )


def max_absolute(samples: DataFrame, bits: int) -> DataFrame:
    """Largest absolute sample of each clip, and how many lie beyond full scale."""
    return samples.groupBy("clip_id").agg(F.max(_size()).alias("peak"), F.count_if(_size() > native_range(bits)[1]).alias("n_clipped"))


def waveform(samples: DataFrame, bits: int, windows: int = 200) -> DataFrame:
    """Peak of each window of max(1, frames div windows) frames; the tail counts as one."""
    frames = samples.groupBy("clip_id").agg((F.max("frame") + 1).alias("n"))
    width = F.greatest(F.floor(F.col("n") / windows), F.lit(1))
    return (
        samples.join(frames, "clip_id")
        .groupBy("clip_id", F.floor(F.col("frame") / width).cast("long").alias("window"))
        .agg((F.max(_size()) / float(1 << (bits - 1))).alias("peak"))
    )


def waveform_array(samples: DataFrame, bits: int, windows: int = 200) -> DataFrame:
    """The windows of each clip as one array."""
    peaks = F.transform(F.sort_array(F.collect_list(F.struct("window", "peak"))), lambda w: w.peak)
    return waveform(samples, bits, windows).groupBy("clip_id").agg(peaks.alias("waveform"))


def _apply_gain(samples: DataFrame, gains: DataFrame, bits: int) -> DataFrame:
    """Samples times their clip's gain (clip_id, gain); a null gain leaves them."""
    x = F.col("sample")
    out = F.when(F.col("gain").isNull(), x).otherwise(truncated(x.cast("double") * F.col("gain"), bits))
    return samples.join(gains, "clip_id").withColumn("sample", out).drop("gain")


def peak_normalize(samples: DataFrame, target_db: float, bits: int) -> DataFrame:
    """Scale each clip so that its peak reaches ``target_db`` (at most 0)."""
    if target_db > 0:
        raise ValueError("the target must not be above 0 dB")
    goal = 10 ** (target_db / 20) * native_range(bits)[1]
    peak = F.max(_size())
    gains = samples.groupBy("clip_id").agg(F.when(peak > 0, F.lit(goal) / peak).alias("gain"))
    near = F.abs(F.col("gain") - 1) < 1e-10
    return _apply_gain(samples, gains.withColumn("gain", F.when(~near, F.col("gain"))), bits)


def k_weights(rate: int) -> list[tuple[float, float, float, float, float]]:
    """The two biquads (b0, b1, b2, a1, a2) of K-weighting at a sample rate."""
    # Fixed values of the standard's filters.
    f0, g, q, e = 1681.974450955533, 3.999843853973347, 0.7071752369554196, 0.4996667741545416
    k, vh = math.tan(math.pi * f0 / rate), 10 ** (g / 20)
    vb, a0 = vh**e, 1 + k / q + k * k
    shelf = ((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)
    f0, q = 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    return [shelf, (1 / a0, -2 / a0, 1 / a0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)]


FILTER_BLOCK = 64


@functools.lru_cache(maxsize=64)
def _block_filter(b0: float, b1: float, b2: float, a1: float, a2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A biquad over blocks: outputs from a block's inputs and from its first state, last state from its inputs and from the first."""
    n = FILTER_BLOCK

    def run(x: float, w1: float, w2: float) -> tuple[np.ndarray, np.ndarray]:
        y, w = np.empty(n), np.empty((n, 2))
        for i in range(n):
            y[i] = b0 * x + w1
            w1, w2 = b1 * x - a1 * y[i] + w2, b2 * x - a2 * y[i]
            w[i], x = (w1, w2), 0.0
        return y, w

    impulse, after = run(1.0, 0.0, 0.0)
    from_input = np.zeros((n, n))
    for i in range(n):
        from_input[i:, i] = impulse[: n - i]
    free = [run(0.0, 1.0, 0.0), run(0.0, 0.0, 1.0)]
    return from_input, np.stack([f[0] for f in free], axis=1), after[::-1].T.copy(), np.stack([f[1][-1] for f in free], axis=1)


def filtered(x: np.ndarray, b0: float, b1: float, b2: float, a1: float, a2: float) -> np.ndarray:
    """A transposed direct-form-II biquad from rest, by blocks: only the two state values run from one to the next."""
    from_input, from_state, state_input, state_state = _block_filter(b0, b1, b2, a1, a2)
    rows = np.zeros(-(-len(x) // FILTER_BLOCK) * FILTER_BLOCK)
    rows[: len(x)] = x
    rows = rows.reshape(-1, FILTER_BLOCK)
    added, states, w = rows @ state_input.T, np.empty((len(rows), 2)), np.zeros(2)
    for i in range(len(rows)):
        states[i] = w
        w = state_state @ w + added[i]
    return (rows @ from_input.T + states @ from_state.T).reshape(-1)[: len(x)]


def step_energies(samples: DataFrame, rate: int, scale: float, partial: bool) -> DataFrame:
    """Mean square of the K-weighted signal for each 100 ms step, summed over channels.

    ``partial`` keeps a shorter last step. Memory is bounded by one channel of one clip.
    """
    width = max(1, round(0.1 * rate))
    sections = k_weights(rate)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        y = pdf["sample"].to_numpy(np.float64) / scale
        for s in sections:
            y = filtered(y, *s)
        full = len(y) // width
        steps = [float(np.mean(y[i * width : (i + 1) * width] ** 2)) for i in range(full)]
        if partial and len(y) > full * width:
            steps.append(float(np.mean(y[full * width :] ** 2)))
        return pd.DataFrame({"clip_id": pdf["clip_id"].iloc[0], "step": range(len(steps)), "energy": steps})

    by = ["clip_id", "channel"] if "channel" in samples.columns else ["clip_id"]
    steps = samples.groupBy(*by).applyInPandas(fold, "clip_id string, step long, energy double")
    return steps.groupBy("clip_id", "step").agg(F.sum("energy").alias("energy"))


def integrated_loudness(samples: DataFrame, rate: int, bits: int | None = 16, partial: bool = True) -> DataFrame:
    """Gated loudness of each clip in LUFS: null if too short, minus infinity if silent.

    Blocks are four steps; the gates are -70 LUFS and 10 LU below the mean of
    what passes it. ``bits`` None means float samples; ``partial`` selects
    whether a shorter last step counts.
    """
    w = Window.partitionBy("clip_id").orderBy("step")
    steps = step_energies(samples, rate, 1.0 if bits is None else float(1 << (bits - 1)), partial)
    four = w.rowsBetween(-3, 0)
    blocks = steps.withColumn("n", F.count("*").over(four)).withColumn("power", F.sum("energy").over(four) / 4).where("n = 4")
    gate = 10 ** ((-70 + 0.691) / 10)
    passed = blocks.where(F.col("power") > gate)
    floor = passed.groupBy("clip_id").agg((F.avg("power") * 0.1).alias("floor"))
    loud = passed.join(floor, "clip_id").where("power > floor").groupBy("clip_id").agg((10 * F.log10(F.avg("power")) - 0.691).alias("lufs"))
    measured = blocks.select("clip_id").distinct().withColumn("any", F.lit(True))
    clips = samples.select("clip_id").distinct()
    value = F.coalesce("lufs", F.when(F.col("any"), F.lit(float("-inf"))))
    return clips.join(measured, "clip_id", "left").join(loud, "clip_id", "left").select("clip_id", value.alias("lufs"))


def loudness_normalize(samples: DataFrame, target_lufs: float, rate: int, bits: int) -> DataFrame:
    """Scale each clip to a loudness; clips without a finite one are left."""
    gains = integrated_loudness(samples, rate, bits)
    finite = F.col("lufs") > float("-inf")
    gains = gains.select("clip_id", F.when(finite, F.pow(F.lit(10.0), (F.lit(target_lufs) - F.col("lufs")) / 20)).alias("gain"))
    return _apply_gain(samples, gains, bits)
