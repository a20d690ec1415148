"""Queries on the order of frames: windows, and recurrences checked by recursive SQL."""

import math

from pyspark.sql import functions as F

from wavelattice.operators import align, analysis, folds, sequence
from wavelattice.plans.registry import query
from wavelattice.plans.tables import micros, read, samples, samples_sql

S = f"WITH {samples_sql()}"
R = f"WITH RECURSIVE {samples_sql()}"
RATE = 8000
_RND = "CAST(greatest(least(round_even({x}, 0), 32767), -32768) AS INTEGER)"
_CUT = "CAST(trunc(greatest(least({x}, {hi}), {lo})) AS INTEGER)"
_E = "WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS frame FROM embeddings)"
TAPS = [0.25, 0.5, -0.125, 0.0625]


@query("fir_short", f"""{S}, f AS (SELECT clip_id, frame, {' + '.join(f"coalesce(lag(sample, {k}) OVER w, 0) * {t}::DOUBLE" if k else f"sample * {t}::DOUBLE" for k, t in enumerate(TAPS))} AS y
    FROM s WINDOW w AS (PARTITION BY clip_id ORDER BY frame)) SELECT clip_id, frame, {_RND.format(x='y')} AS sample FROM f""")
def fir_short(spark, sf_dir):
    return sequence.fir(samples(spark, sf_dir), TAPS, 16)


@query("sliding_max", f"{S} SELECT clip_id, frame, max(sample) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS sample FROM s")
def sliding_max(spark, sf_dir):
    return sequence.sliding(samples(spark, sf_dir), 3, 2, "max")


@query("sliding_min", f"{S} SELECT clip_id, frame, min(sample) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS sample FROM s")
def sliding_min(spark, sf_dir):
    return sequence.sliding(samples(spark, sf_dir), 5, 0, "min")


@query("echo_dry", f"""{S}, e AS (SELECT clip_id, frame, sample + 0.6::DOUBLE * coalesce(lag(sample, 9) OVER (PARTITION BY clip_id ORDER BY frame), 0) AS y FROM s)
    SELECT clip_id, frame, {_CUT.format(x='y', lo=-32768, hi=32767)} AS sample FROM e""")
def echo_dry(spark, sf_dir):
    return sequence.echo_dry(samples(spark, sf_dir), 9, 0.6, 16)


def _biquad_sql(c, out="sample", source="s"):
    """A transposed direct-form-II section as a recursive CTE r(clip_id, frame, y, w1, w2)."""
    b0, b1, b2, a1, a2 = (f"({x!r}::DOUBLE)" for x in c)
    return f"""r AS (SELECT clip_id, frame, {b0} * {out} AS y, {b1} * {out} - {a1} * ({b0} * {out}) AS w1, {b2} * {out} - {a2} * ({b0} * {out}) AS w2 FROM {source} WHERE frame = 0
      UNION ALL SELECT s.clip_id, s.frame, {b0} * s.{out} + r.w1, {b1} * s.{out} - {a1} * ({b0} * s.{out} + r.w1) + r.w2, {b2} * s.{out} - {a2} * ({b0} * s.{out} + r.w1)
      FROM r JOIN {source} s ON s.clip_id = r.clip_id AND s.frame = r.frame + 1)"""


def _register_biquads():
    for kind in ("low_pass", "high_pass", "band_pass", "notch", "all_pass", "peaking", "low_shelf", "high_shelf"):
        q, gain = (0.8, 6.0) if kind in ("peaking", "low_shelf", "high_shelf") else (0.7071, 0.0)
        c = folds.biquad_coefficients(kind, RATE, 900, q, gain)

        @query(f"biquad_{kind}", f"{R}, {_biquad_sql(c)} SELECT clip_id, frame, {_RND.format(x='round(y, 6)')} AS sample FROM r")
        def run(spark, sf_dir, kind=kind, q=q, gain=gain):
            return folds.biquad(samples(spark, sf_dir), kind, RATE, 900, q, 16, gain)


_register_biquads()


@query("biquad_coefficients", "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', " + ", ".join(f"{round(x, 6)!r}::DOUBLE" for x in folds.biquad_coefficients(k, 48000, 1000, 0.7071)) + ")" for k in ("low_pass", "high_pass")) + ") t(kind, b0, b1, b2, a1, a2)")
def biquad_coefficients(spark, sf_dir):
    """Low and high pass at 1 kHz, worked out in column expressions from the cookbook."""
    w0, q = 2 * math.pi * 1000 / 48000, 0.7071
    kinds = spark.createDataFrame([("low_pass", 1.0), ("high_pass", -1.0)], "kind string, s double")
    cos, alpha = F.cos(F.lit(w0)), F.sin(F.lit(w0)) / (2 * q)
    b0 = (1 - F.col("s") * cos) / 2
    parts = {"b0": b0, "b1": F.col("s") * 2 * b0, "b2": b0, "a1": -2 * cos, "a2": 1 - alpha}
    return kinds.select("kind", *[F.round(x / (1 + alpha), 6).alias(n) for n, x in parts.items()])


_BUTTER = folds.butterworth_stages("low_pass", 4, RATE, 1200)


def _butter_sql():
    first = _biquad_sql(_BUTTER[0])
    second = _biquad_sql(_BUTTER[1], source="m").replace("r AS (", "q AS (", 1).replace("r.", "q.").replace("FROM r JOIN", "FROM q JOIN")
    return f"{R}, {first}, m AS (SELECT clip_id, frame, {_RND.format(x='round(y, 6)')} AS sample FROM r), {second} SELECT clip_id, frame, {_RND.format(x='round(y, 6)')} AS sample FROM q"


@query("butterworth4", _butter_sql())
def butterworth4(spark, sf_dir):
    return folds.butterworth(samples(spark, sf_dir), "low_pass", 4, RATE, 1200, 16)


def _envelope_sql(attack, release):
    a, r = (f"({folds.time_constant(RATE, ms)!r}::DOUBLE)" for ms in (attack, release))
    return f"""e AS (SELECT clip_id, frame, sample, (1 - {a}) * abs(CAST(sample AS DOUBLE)) AS env FROM s WHERE frame = 0
      UNION ALL SELECT s.clip_id, s.frame, s.sample, CASE WHEN abs(s.sample) > e.env THEN {a} * e.env + (1 - {a}) * abs(s.sample) ELSE {r} * e.env + (1 - {r}) * abs(s.sample) END
      FROM e JOIN s ON s.clip_id = e.clip_id AND s.frame = e.frame + 1)"""


def _dynamics_sql(attack, release, gain, lo=-32768, hi=32767):
    y = _CUT.format(x="round(sample * g, 6)", lo=f"({lo!r}::DOUBLE)", hi=f"({hi!r}::DOUBLE)")
    return f"{R}, {_envelope_sql(attack, release)}, d AS (SELECT clip_id, frame, sample, env, CASE WHEN env <= 0 THEN NULL ELSE 20 * log10(env / 32767) END AS db FROM e), g AS (SELECT *, {gain} AS g FROM d) SELECT clip_id, frame, {y} AS sample FROM g"


@query("compressor", _dynamics_sql(1, 20, "pow(10, (3 - CASE WHEN db > -12 THEN (db + 12) * (1 - 1 / 4.0::DOUBLE) ELSE 0 END) / 20)"))
def compressor(spark, sf_dir):
    return folds.compressor(samples(spark, sf_dir), RATE, -12, 4, 1, 20, 3, 16)


@query("noise_gate", _dynamics_sql(1, 10, "CASE WHEN db IS NULL THEN 0 WHEN db < -9 THEN pow(10, -((-9 - db) * (1 - 1 / 3.0::DOUBLE)) / 20) ELSE 1.0::DOUBLE END"))
def noise_gate(spark, sf_dir):
    return folds.noise_gate(samples(spark, sf_dir), RATE, -9, 3, 1, 10, 16)


_TOP = 10 ** (-3 / 20) * 32767


@query("limiter", _dynamics_sql(0, 50, f"CASE WHEN env > {_TOP!r}::DOUBLE THEN {_TOP!r}::DOUBLE / env ELSE 1.0::DOUBLE END", max(-32768, -_TOP), min(32767, _TOP)))
def limiter(spark, sf_dir):
    return folds.limiter(samples(spark, sf_dir), RATE, -3, 50, 0, 16)


_TAIL = math.ceil(math.log(0.001) / math.log(0.5)) * 8


@query("echo_feedback", f"""{R}, n AS (SELECT clip_id, max(frame) + 1 + {_TAIL} AS n FROM s GROUP BY clip_id),
    x AS (SELECT n.clip_id, f.frame, coalesce(s.sample, 0) AS sample FROM n JOIN (SELECT unnest(range(400)) AS frame) f ON f.frame < n.n LEFT JOIN s ON s.clip_id = n.clip_id AND s.frame = f.frame),
    l AS (SELECT clip_id, frame, sample, {_CUT.format(x='sample * 1.0::DOUBLE', lo=-32768, hi=32767)} AS line, {_CUT.format(x='sample * 1.0::DOUBLE', lo=-32768, hi=32767)} AS y FROM x WHERE frame < 8
      UNION ALL SELECT x.clip_id, x.frame, x.sample, {_CUT.format(x='x.sample + 0.5::DOUBLE * l.line', lo=-32768, hi=32767)}, {_CUT.format(x='x.sample + 0.7::DOUBLE * l.line', lo=-32768, hi=32767)}
      FROM l JOIN x ON x.clip_id = l.clip_id AND x.frame = l.frame + 8)
    SELECT clip_id, CAST(frame AS BIGINT) AS frame, y AS sample FROM l""")
def echo_feedback(spark, sf_dir):
    return folds.echo(samples(spark, sf_dir), RATE, 0.001, 0.5, 0.7, 16)


@query("envelope", f"{R}, {_envelope_sql(2, 30)} SELECT clip_id, frame, round(env, 6) AS env FROM e")
def envelope(spark, sf_dir):
    """The one-pole envelope behind the dynamics, as a fold over Arrow groups."""
    import numpy as np
    import pandas as pd

    a, r = folds.time_constant(RATE, 2), folds.time_constant(RATE, 30)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        return pd.DataFrame({"clip_id": pdf["clip_id"], "frame": pdf["frame"], "env": folds.envelope(np.abs(pdf["sample"].to_numpy(np.float64)), a, r)})

    return samples(spark, sf_dir).groupBy("clip_id").applyInPandas(run, "clip_id string, frame long, env double").withColumn("env", F.round("env", 6))


def _k_sql(kind):
    """Integrated loudness of the event_type clips at 4 kHz by two recursive sections."""
    shelf, high = analysis.k_weights(4000)
    one = _biquad_sql(shelf, out="x", source="f")
    two = _biquad_sql(high, out="x", source="m").replace("r AS (", "q AS (", 1).replace("r.", "q.").replace("FROM r JOIN", "FROM q JOIN")
    return f"""WITH RECURSIVE {samples_sql("event_type")}, f AS (SELECT clip_id, frame, CAST(sample AS DOUBLE) / 32768 AS x FROM s), {one},
    m AS (SELECT clip_id, frame, y AS x FROM r), {two},
    st AS (SELECT clip_id, frame // 400 AS step, avg(y * y) AS e FROM q GROUP BY ALL {kind}),
    b AS (SELECT clip_id, count(*) OVER w AS n, sum(e) OVER w / 4 AS p FROM st WINDOW w AS (PARTITION BY clip_id ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    g AS (SELECT clip_id, p FROM b WHERE n = 4 AND p > pow(10, (-70 + 0.691) / 10)), fl AS (SELECT clip_id, avg(p) * 0.1 AS fl FROM g GROUP BY clip_id),
    ll AS (SELECT clip_id, round(10 * log10(avg(p)) - 0.691, 4) AS lufs FROM g JOIN fl USING (clip_id) WHERE p > fl GROUP BY clip_id),
    bb AS (SELECT DISTINCT clip_id, true AS measured FROM b WHERE n = 4)
    SELECT clip_id, coalesce(lufs, CASE WHEN measured THEN CAST('-infinity' AS DOUBLE) END) AS lufs FROM (SELECT DISTINCT clip_id FROM s) LEFT JOIN bb USING (clip_id) LEFT JOIN ll USING (clip_id)"""


@query("loudness_integrated", _k_sql(""))
def loudness_integrated(spark, sf_dir):
    return analysis.integrated_loudness(samples(spark, sf_dir, "event_type"), 4000, 16).withColumn("lufs", F.round("lufs", 4))


@query("loudness_meter", _k_sql("HAVING count(*) = 400"))
def loudness_meter(spark, sf_dir):
    return analysis.integrated_loudness(samples(spark, sf_dir, "event_type"), 4000, 16, partial=False).withColumn("lufs", F.round("lufs", 4))


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("clip_id"), F.posexplode("embedding").alias("frame", "sample"))


_TAPS = ", ".join(f"({p}, {k - 23}, {x!r}::DOUBLE)" for p, row in enumerate(sequence.oversampling_rows().tolist()) if p for k, x in enumerate(row))


@query("true_peak", f"""{_E}, t AS (SELECT * FROM (VALUES {_TAPS}) t(phase, k, w)),
    o AS (SELECT vec_id, t.phase, v.frame - t.k AS n, sum(CAST(x AS DOUBLE) * w) AS y FROM v, t WHERE v.frame - t.k BETWEEN 0 AND 63 GROUP BY ALL),
    m AS (SELECT vec_id, max(a) AS p FROM (SELECT vec_id, abs(y) AS a FROM o UNION ALL SELECT vec_id, abs(CAST(x AS DOUBLE)) FROM v) GROUP BY vec_id)
    SELECT CAST(vec_id AS VARCHAR) AS clip_id, round(20 * log10(p), 6) AS peak_db FROM m""")
def true_peak(spark, sf_dir):
    return sequence.true_peak(_vectors(spark, sf_dir)).withColumn("peak_db", F.round("peak_db", 6))


@query("mdct", """WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings)
    SELECT vec_id, k, round(sum(CAST(x AS DOUBLE) * cos(pi() / 32 * (t + 0.5 + 16) * (k + 0.5))), 6) AS c FROM v, (SELECT CAST(unnest(range(32)) AS INTEGER) AS k) GROUP BY vec_id, k""")
def mdct(spark, sf_dir):
    out = sequence.mdct(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return out.select("vec_id", F.posexplode("mdct").alias("k", "c")).withColumn("c", F.round("c", 6))


@query("sample_and_hold", """SELECT e.user_id, epoch_us(e.ts) AS t, c.event_id AS held FROM (SELECT user_id, ts FROM events WHERE event_type = 'click') e
    ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase') c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def sample_and_hold(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", micros("ts").alias("t"), "event_id", "event_type")
    times, frames = e.where("event_type = 'click'").select("user_id", "t"), e.where("event_type = 'purchase'").select("user_id", "t", "event_id")
    return align.sample_and_hold(times, frames, ["user_id"], ["event_id"]).withColumnRenamed("event_id", "held")


@query("subtitle_range_join", """WITH i AS (SELECT event_id AS cue, epoch_us(ts) AS a, epoch_us(ts) + CAST(value * 1000000 AS BIGINT) AS b FROM events WHERE event_type = 'signup')
    SELECT event_id, epoch_us(ts) AS t, cue FROM events JOIN i ON epoch_us(ts) >= a AND epoch_us(ts) < b""")
def subtitle_range_join(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", micros("ts").alias("t"), "event_type", "value")
    cues = e.where("event_type = 'signup'").select(F.col("event_id").alias("cue"), F.col("t").alias("start"), (F.col("t") + F.round(F.col("value") * 1000000).cast("long")).alias("end"))
    return align.active_intervals(e.select("event_id", "t"), cues, 600_000_000, ["cue"])
