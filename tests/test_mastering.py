import math

import numpy as np

from pyspark.sql import functions as F

from wavelattice.operators import mastering
from wavelattice.operators.analysis import integrated_loudness


def test_limiter_holds_the_ceiling():
    rng = np.random.default_rng(1)
    x = np.stack([rng.normal(0, 0.5, 6000), rng.normal(0, 0.5, 6000)], axis=1)
    y = mastering.limited(x, 8000, 0.5)
    assert mastering.frame_peaks(y).max() <= 0.5 + 1e-9 and y.shape == x.shape
    quiet = x * 0.01
    assert mastering.limited(quiet, 8000, 0.5) is quiet


def test_normalised_loudness(spark):
    t = np.arange(16000)
    rows = [("a", int(i), float(0.05 * math.sin(2 * math.pi * 500 * i / 8000))) for i in t] + [("s", i, 0.0) for i in range(4000)]
    clips = spark.createDataFrame(rows, "clip_id string, frame long, sample double").withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1))))
    out = mastering.normalize(clips, 8000, -16.0, -1.0)
    got = {r.clip_id: r.lufs for r in integrated_loudness(out, 8000, None).collect()}
    assert abs(got["a"] + 16) < 0.1 and got["s"] == float("-inf")


def test_filters_by_blocks_equal_a_plain_loop():
    from wavelattice.operators import analysis, folds

    rng = np.random.default_rng(2)
    for n in (0, 1, 64, 65, 1000):
        x = rng.normal(size=n) * 9000
        for b0, b1, b2, a1, a2 in (*analysis.k_weights(48000), folds.biquad_coefficients("notch", 8000, 900)):
            want, w1, w2 = [], 0.0, 0.0
            for v in x.tolist():
                y = b0 * v + w1
                w1, w2 = b1 * v - a1 * y + w2, b2 * v - a2 * y
                want.append(y)
            got = analysis.filtered(x, b0, b1, b2, a1, a2)
            assert len(got) == n and np.allclose(got, want, rtol=1e-9, atol=1e-6)
