"""Golden values, edge cases and independence of partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelattice.operators import align, analysis, folds, frames, packets, sequence
from wavelattice.operators import pointwise as pw
from wavelattice.operators.format import Format, native_range


def clip(spark, values, name="a", parts=1):
    kind = "double" if any(isinstance(v, float) for v in values) else "int"
    return spark.createDataFrame([(name, i, v) for i, v in enumerate(values)], f"clip_id string, frame long, sample {kind}").repartition(parts)


def values(df):
    return [r.sample for r in df.orderBy("frame").collect()]


def tone(n, rate, db, f=997):
    return [float(x) for x in 10 ** (db / 20) * np.sin(2 * np.pi * f * np.arange(n) / rate)]


def test_rescale_goldens(spark):
    rows = [(1024, 44100, 90000, 2090), (-1024, 44100, 90000, -2090), (2**63 - 1, 90000, 1000, 102481911520608620), (-(2**63), 90000, 1000, -102481911520608620)]
    rows += [(v, 2, 1, e) for v, e in zip((1, 3, 5, 7, -1, -3, -5), (0, 2, 2, 4, 0, -2, -2), strict=True)]
    df = spark.createDataFrame(rows, "v long, s long, t long, e long")
    assert df.withColumn("g", packets.rescale(F.col("v"), F.col("s"), F.col("t"))).where("g != e").collect() == []


def test_g711_goldens(spark):
    codes = spark.createDataFrame([(c,) for c in (0, 0x55, 0xD5, 0xFF, 0x7F, 0x80)], "c int")
    assert [r[0] for r in codes.select(pw.alaw_expand(F.col("c"))).collect()] == [-5504, -8, 8, 848, -848, 5504]
    assert [r[0] for r in codes.select(pw.mulaw_expand(F.col("c"))).collect()] == [-32124, -716, 716, 0, 0, 32124]


def test_gain_edges(spark):
    s = clip(spark, [-32768, 32767, 0, 5, -5])
    assert values(s.withColumn("sample", pw.gain(F.col("sample"), 2.0, 16))) == [-32768, 32767, 0, 10, -10]
    assert values(s.withColumn("sample", pw.gain(F.col("sample"), 0.3, 16))) == [-9830, 9830, 0, 1, -1]
    for bad in (-1.0, math.nan, math.inf):
        with pytest.raises(ValueError):
            pw.gain(F.col("sample"), bad, 16)


def test_float_edges(spark):
    s = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (0.5,)], "x double")
    assert [tuple(r) for r in s.select(pw.float_to_int32(F.col("x")), pw.float_to_int16(F.col("x"))).collect()] == [(0, 0), (2147483647, 32767), (-2147483647, -32768), (1073741823, 16384)]


def test_bit_depths(spark):
    s = clip(spark, [-32768, -129, -128, 127, 128, 32767])
    assert values(s.withColumn("sample", pw.rescale_bits(F.col("sample"), 16, 8))) == [-128, -1, -1, 0, 1, 127]
    with pytest.raises(ValueError):
        native_range(12)
    with pytest.raises(ValueError):
        Format(0, 8000, 16)


def test_remix_matrices():
    assert pw.remix_matrix(2, 1) == [(0, 0, 0.5), (1, 0, 0.5)]
    assert pw.remix_matrix(1, 2) == [(0, 0, 1.0), (0, 1, 1.0)]
    assert [m[:2] for m in pw.remix_matrix(6, 2)] == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1)]


def test_colours(spark):
    s = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (255, 0, 0)], "r int, g int, b int")
    y, cb, cr = pw.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    out = s.select("r", "g", "b", y.alias("y"), cb.alias("cb"), cr.alias("cr"))
    assert [(r.y, r.cb, r.cr) for r in out.collect()] == [(16, 128, 128), (235, 128, 128), (81, 90, 240)]
    back = pw.ycbcr_to_rgb(F.col("y"), F.col("cb"), F.col("cr"))
    assert all(abs(a - b) <= 2 for r in out.select("r", "g", "b", *back).collect() for a, b in zip(r[:3], r[3:], strict=True))


def test_length_rules():
    assert align.length_rule([3, 2, 4], "longest") == 4 and align.length_rule([3, 2, 4], "shortest") == 2 and align.length_rule([3, 2, 4], "first") == 3
    with pytest.raises(ValueError):
        align.length_rule([None, 2], "longest")


@pytest.mark.parametrize("db", [-23, -20, -40])
def test_loudness_of_a_stereo_sine(spark, db):
    x = tone(48000 * 2, 48000, db)
    rows = clip(spark, x).withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1))))
    assert analysis.integrated_loudness(rows, 48000, None).first().lufs == pytest.approx(db, abs=0.1)


def test_loudness_of_short_and_silent_clips(spark):
    short, silent = clip(spark, [0.1] * 399, "short"), clip(spark, [0.0] * 4000, "silent")
    got = {r.clip_id: r.lufs for r in analysis.integrated_loudness(short.union(silent), 4000, None).collect()}
    assert got == {"short": None, "silent": float("-inf")}
    part = clip(spark, [0.1] * 1500)
    assert analysis.integrated_loudness(part, 4000, None).first().lufs is not None
    assert analysis.integrated_loudness(part, 4000, None, partial=False).first().lufs is None


def test_true_peak_between_samples(spark):
    x = [0.9 * math.sin(math.pi / 2 * i + math.pi / 4) for i in range(4800)]
    assert sequence.true_peak(clip(spark, x)).first().peak_db == pytest.approx(-0.9, abs=0.12)


@pytest.mark.parametrize("parts", [1, 8])
def test_folds_do_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(3)
    x = rng.integers(-32768, 32768, 300).tolist()
    got = values(folds.biquad(clip(spark, x, parts=parts), "low_pass", 8000, 900, 0.7071, 16))
    c = folds.biquad_coefficients("low_pass", 8000, 900, 0.7071)
    assert got == np.clip(np.rint(analysis.filtered(np.array(x, float), *c)), -32768, 32767).astype(int).tolist()


def test_impulse_and_tail_of_an_echo(spark):
    got = values(folds.echo(clip(spark, [1000, 0, 0]), 1000, 0.002, 0.5, 1.0, 16))
    assert got[:9] == [1000, 0, 1000, 0, 500, 0, 250, 0, 125] and len(got) == 3 + 10 * 2


def test_dynamics_edges(spark):
    silence = clip(spark, [0] * 10)
    assert values(folds.compressor(silence, 8000, -20, 4, 1, 10, 0, 16)) == [0] * 10
    assert values(folds.noise_gate(silence, 8000, -20, 4, 1, 10, 16)) == [0] * 10
    loud = values(folds.limiter(clip(spark, [32767, -32768] * 5), 8000, -6, 50, 0, 16))
    assert max(map(abs, loud)) <= 16423
    with pytest.raises(ValueError):
        folds.biquad_coefficients("low_pass", 8000, 4000)
    with pytest.raises(ValueError):
        folds.butterworth_stages("low_pass", 3, 8000, 100)


def test_resampling(spark):
    x = (10000 * np.sin(2 * np.pi * 100 * np.arange(2000) / 8000)).round().astype(int).tolist()
    y = values(sequence.resample(clip(spark, x), 8000, 16000))
    assert len(y) == 4000 and np.abs(np.array(y[200:3800:2]) - np.array(x[100:1900])).max() <= 12
    assert values(sequence.resample(clip(spark, [7] * 50), 8000, 6000)) == [7] * 38


def test_gap_fill_goldens(spark):
    rows = [("s", 0, 100), ("s", 2_000_000, 100)]
    got = packets.fill_gaps(spark.createDataFrame(rows, "source_id string, ts_us long, n_frames long"), 1000).orderBy("ts_us").collect()
    assert [r.fill_frames for r in got] == [0, 1900]
    rows = [("s", 0, 100), ("s", 120_000, 100)]
    got = packets.fill_gaps(spark.createDataFrame(rows, "source_id string, ts_us long, n_frames long"), 1000).collect()
    assert [r.fill_frames for r in got] == [0, 0]


def test_one_segment_for_44_frames(spark):
    rows = [("s", 1024, i) for i in range(44)]
    got = packets.frame_segments(spark.createDataFrame(rows, "source_id string, sample_count long, n long"), 44100, 1.0, ("n",)).collect()
    assert [(r.sequence, r.n_frames) for r in got] == [(1, 44)]


def test_playlist(spark):
    rows = [("s", 1, 2.0, "a.ts", False), ("s", 2, 1.5, "b.ts", True)]
    got = packets.media_playlist(spark.createDataFrame(rows, "source_id string, sequence long, duration_s double, uri string, discontinuity boolean"), 1.0).first().playlist
    assert got == "#EXTM3U\n#EXT-X-VERSION:7\n#EXT-X-TARGETDURATION:2\n#EXT-X-MEDIA-SEQUENCE:1\n#EXTINF:2.000000,\na.ts\n#EXT-X-DISCONTINUITY\n#EXTINF:1.500000,\nb.ts\n#EXT-X-ENDLIST\n"


def test_duck_gains_are_one_below_the_knee():
    s = folds.DuckSettings()
    assert (folds.duck_gains(np.full(100, 0.01), 8000, s) == 1).all()
    loud = folds.duck_gains(np.full(4000, 0.5), 8000, s)
    assert loud[-1] == pytest.approx(math.exp((math.log(0.5) - math.log(0.125)) * (1 / 2 - 1)), rel=1e-2)


def _frame(spark, y):
    h, w = y.shape
    c = np.full(((h + 1) // 2, (w + 1) // 2), 128, np.uint8)
    schema = "clip_id string, frame_no long, ts_ticks long, width int, height int, y binary, u binary, v binary"
    return spark.createDataFrame([("a", 0, 5, w, h, y.tobytes(), c.tobytes(), c.tobytes())], schema)


def _luma(df):
    r = df.first()
    return np.frombuffer(r.y, np.uint8).reshape(r.height, r.width)


def test_frame_geometry(spark):
    y = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert (_luma(frames.rotate(_frame(spark, y), 90)) == np.rot90(y, -1)).all()
    assert (_luma(frames.crop(_frame(spark, y), 2, 2, 4, 2)) == y[2:4, 2:6]).all()
    assert (_luma(frames.pad(_frame(spark, y), 12, 10, 2, 2))[2:8, 2:10] == y).all()
    assert (_luma(frames.scale(_frame(spark, np.full((6, 8), 77, np.uint8)), 12, 4)) == 77).all()
    assert (_luma(frames.box_blur(_frame(spark, np.full((6, 8), 9, np.uint8)), 2, 1)) == 9).all()
    assert (_luma(frames.fade(_frame(spark, y), 0, 10, True)) == (y.astype(int) * 128 + 16 * 128 + 128 >> 8)).all()
    assert frames.fit_plan(1920, 1080, 1080, 1920, "contain") == (1080, 608) and frames.fit_plan(1920, 1080, 1080, 1920, "cover") == (3414, 1920)
