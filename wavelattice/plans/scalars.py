"""Queries on formats, lengths, predicates and times, and oracles for resampling, ducking and loudness."""

import math

from pyspark.sql import functions as F

from wavelattice.operators import align, analysis, folds, packets as pk, pipeline, sequence
from wavelattice.operators import pointwise as pw
from wavelattice.operators.format import BITS, Format, native_range
from wavelattice.plans.registry import query
from wavelattice.plans.sequences import _RND, RATE, S, _k_sql, _vectors
from wavelattice.plans.tables import PACKETS_SQL, packets, read, samples, samples_sql, stereo, stereo_sql


def _resample_sql(key: str, source: int, target: int, half_width: int = 32) -> str:
    """Windowed-sinc weights by the closed form, the Bessel function by its series, as joins of outputs and taps."""
    ratio = target / source
    cutoff = min(1.0, ratio)
    hw = min(256, math.ceil(half_width / cutoff))
    beta = 0.1102 * (80 - 8.7)
    return f"""WITH {samples_sql(key)}, n AS (SELECT clip_id, max(frame) + 1 AS n FROM s GROUP BY clip_id),
    o AS (SELECT clip_id, n, unnest(range(CAST(round_even(n * {ratio!r}::DOUBLE, 0) AS BIGINT))) AS i FROM n),
    a AS (SELECT *, i * {1 / ratio!r}::DOUBLE AS spot FROM o), b AS (SELECT *, floor(spot) AS base, least(1023, CAST(round_even((spot - floor(spot)) * 1024, 0) AS INTEGER)) AS phase FROM a),
    t AS (SELECT phase, j, j - {hw} + 1 - phase / 1024.0::DOUBLE AS x FROM (SELECT DISTINCT phase FROM b), unnest(range({2 * hw})) u(j)),
    z AS (SELECT *, {beta!r}::DOUBLE * sqrt(greatest(0, 1 - (x / {hw}) * (x / {hw}))) / 2 AS z FROM t WHERE abs(x) <= {hw}),
    k AS (SELECT phase, j, CASE WHEN x * {cutoff!r}::DOUBLE = 0 THEN 1.0 ELSE sin(pi() * x * {cutoff!r}::DOUBLE) / (pi() * x * {cutoff!r}::DOUBLE) END * list_sum([pow(z, 2 * m) / pow(CAST(factorial(CAST(m AS INTEGER)) AS DOUBLE), 2) for m in range(30)]) AS w FROM z),
    kn AS (SELECT phase, j, w / sum(w) OVER (PARTITION BY phase) AS w FROM k),
    y AS (SELECT b.clip_id, b.i, sum(s.sample * kn.w) AS y FROM b JOIN kn USING (phase) JOIN s ON s.clip_id = b.clip_id AND s.frame = greatest(0, least(b.n - 1, CAST(b.base AS BIGINT) + kn.j - {hw} + 1)) GROUP BY b.clip_id, b.i)
    SELECT clip_id, i AS frame, CAST(round_even(y, 0) AS INTEGER) AS sample FROM y"""


@query("resample_up", _resample_sql("user_id", 8000, 11025))
def resample_up(spark, sf_dir):
    return sequence.resample(samples(spark, sf_dir), 8000, 11025)


@query("resample_down", _resample_sql("event_type", 48000, 16000))
def resample_down(spark, sf_dir):
    return sequence.resample(samples(spark, sf_dir, "event_type"), 48000, 16000)


@query("loudness_normalize", _k_sql("").replace("round(10 * log10(avg(p)) - 0.691, 4)", "10 * log10(avg(p)) - 0.691").replace("SELECT clip_id, coalesce(lufs", "SELECT s.clip_id, s.frame, CAST(CASE WHEN lufs IS NULL THEN sample ELSE trunc(greatest(-32768.0, least(32767.0, sample * pow(10, (-16.0::DOUBLE - lufs) / 20)))) END AS INTEGER) AS sample FROM s LEFT JOIN ll USING (clip_id) --"))
def loudness_normalize(spark, sf_dir):
    return analysis.loudness_normalize(samples(spark, sf_dir, "event_type"), -16.0, 4000, 16)


def _duck_sql(s: folds.DuckSettings) -> str:
    attack, release = (min(1.0, 4000.0 / (ms * RATE)) for ms in (s.attack_ms, s.release_ms))
    log_t, log_k = math.log(s.threshold), math.log(s.knee)
    start, stop, floor = log_t - log_k / 2, log_t + log_k / 2, s.threshold**2 / s.knee
    width, out_stop = stop - start, (stop - log_t) / s.ratio + log_t
    step = f"CASE WHEN k > {{l}} THEN {attack!r}::DOUBLE ELSE {release!r}::DOUBLE END"
    return f"""WITH RECURSIVE v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS frame FROM embeddings), q AS (SELECT *, pow(CAST(CAST(x * 4 AS FLOAT) AS DOUBLE), 2) AS k FROM v),
    e AS (SELECT vec_id, frame, x, k * {step.format(l='0')} AS l FROM q WHERE frame = 0
      UNION ALL SELECT q.vec_id, q.frame, q.x, e.l + (q.k - e.l) * {step.format(l='e.l')} FROM e JOIN q ON q.vec_id = e.vec_id AND q.frame = e.frame + 1),
    g AS (SELECT *, CASE WHEN l > {floor!r}::DOUBLE THEN ln(l) * 0.5 END AS sl FROM e), h AS (SELECT *, (sl - {start!r}::DOUBLE) / {width!r}::DOUBLE AS t FROM g),
    o AS (SELECT *, CASE WHEN sl < {stop!r}::DOUBLE THEN (2 * t * t * t - 3 * t * t + 1) * {start!r}::DOUBLE + (t * t * t - 2 * t * t + t) * {width!r}::DOUBLE + (-2 * t * t * t + 3 * t * t) * {out_stop!r}::DOUBLE + (t * t * t - t * t) * {width / s.ratio!r}::DOUBLE
      ELSE (sl - {log_t!r}::DOUBLE) / {s.ratio!r}::DOUBLE + {log_t!r}::DOUBLE END AS lo FROM h)
    SELECT CAST(vec_id AS VARCHAR) AS clip_id, CAST(frame AS BIGINT) AS frame, round(CAST(CAST(CAST(x AS DOUBLE) * coalesce(exp(lo - sl), 1) AS FLOAT) AS DOUBLE), 5) AS sample FROM o"""


_DUCK = folds.DuckSettings(attack_ms=0.5, release_ms=5)


@query("sidechain_duck", _duck_sql(_DUCK))
def sidechain_duck(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    key = v.withColumn("sample", F.col("sample") * 4)
    return folds.duck(v, key, RATE, _DUCK).select("clip_id", "frame", F.round(F.col("sample").cast("double"), 5).alias("sample"))


LONG_TAPS = [((k * 37) % 64 - 32) / 1024 for k in range(48)]


@query("fir_long", f"""{S}, f AS (SELECT a.clip_id, a.frame, sum(b.sample * {LONG_TAPS}[a.frame - b.frame + 1]) AS y FROM s a JOIN s b ON b.clip_id = a.clip_id AND b.frame BETWEEN a.frame - 47 AND a.frame GROUP BY ALL)
    SELECT clip_id, frame, {_RND.format(x='y')} AS sample FROM f""")
def fir_long(spark, sf_dir):
    return sequence.fir(samples(spark, sf_dir), LONG_TAPS, 16)


@query("imdct", """WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
    SELECT vec_id, t, round(sum(CAST(x AS DOUBLE) * cos(pi() / 64 * (t + 0.5 + 32) * (k + 0.5))) / 64, 6) AS v FROM v, (SELECT CAST(unnest(range(128)) AS INTEGER) AS t) GROUP BY vec_id, t""")
def imdct(spark, sf_dir):
    out = sequence.imdct(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return out.select("vec_id", F.posexplode("imdct").alias("t", "v")).withColumn("v", F.round("v", 6))


@query("int_to_float", f"{S} SELECT clip_id, frame, round(CAST(CAST(CAST(sample AS DOUBLE) / 32767 AS FLOAT) AS DOUBLE), 6) AS value FROM s")
def int_to_float(spark, sf_dir):
    return samples(spark, sf_dir).select("clip_id", "frame", F.round(pw.to_float(F.col("sample"), 16).cast("double"), 6).alias("value"))


@query("native_range_clamp", f"""{S}, b AS (SELECT * FROM (VALUES (8), (16), (24), (32)) t(bits)) SELECT clip_id, frame, CAST(bits AS INTEGER) AS bits,
    CAST(greatest(-(1::BIGINT << (bits - 1)), least((1::BIGINT << (bits - 1)) - 1, sample * 70000::BIGINT)) AS BIGINT) AS sample FROM s, b""")
def native_range_clamp(spark, sf_dir):
    wide = F.col("sample").cast("long") * 70000
    cut = [F.struct(F.lit(b).alias("bits"), F.greatest(F.lit(native_range(b)[0]).cast("long"), F.least(F.lit(native_range(b)[1]).cast("long"), wide)).alias("sample")) for b in BITS]
    return samples(spark, sf_dir).select("clip_id", "frame", F.inline(F.array(*cut)))


@query("empty_pipeline", f"{S} SELECT clip_id, frame, sample FROM s")
def empty_pipeline(spark, sf_dir):
    """A chain of transforms that change nothing."""
    chain = pipeline.Pipeline([pipeline.Gain(1.0), pipeline.Resample(8000), pipeline.Channels(1)])
    return chain.apply(samples(spark, sf_dir), Format(1, 8000, 16))


@query("pipeline_chain", f"""{S}, g AS (SELECT clip_id, frame, CAST(trunc(greatest(-32768.0, least(32767.0, CAST(sample AS DOUBLE) * 0.5))) AS INTEGER) AS a FROM s),
    m AS (SELECT clip_id, max(abs(CAST(a AS BIGINT))) AS p FROM g GROUP BY clip_id), n AS (SELECT *, CASE WHEN p > 0 THEN pow(10, -6 / 20.0::DOUBLE) * 32767 / p END AS k FROM m)
    SELECT clip_id, frame, CAST(CASE WHEN k IS NULL OR abs(k - 1) < 1e-10 THEN a ELSE trunc(greatest(-32768.0, least(32767.0, CAST(a AS DOUBLE) * k))) END AS INTEGER) AS sample FROM g JOIN n USING (clip_id)""")
def pipeline_chain(spark, sf_dir):
    chain = pipeline.Pipeline([pipeline.Gain(0.5), pipeline.PeakNormalize(-6.0)])
    return chain.apply(samples(spark, sf_dir), Format(1, 8000, 16)).select("clip_id", "frame", "sample")


@query("format_conversion", f"""WITH {stereo_sql()} SELECT clip_id, frame, CAST(0 AS INTEGER) AS channel, CAST(round_even(sum(CAST(sample AS DOUBLE) * 0.5), 0) * 256 AS INTEGER) AS sample FROM t GROUP BY clip_id, frame""")
def format_conversion(spark, sf_dir):
    """Stereo of 16 bits to mono of 24 bits."""
    chain = pipeline.Pipeline([pipeline.Channels(1), pipeline.BitDepth(24)])
    return chain.apply(stereo(spark, sf_dir), Format(2, 8000, 16)).select("clip_id", "frame", F.col("channel").cast("int").alias("channel"), "sample")


@query("time_window", f"WITH {PACKETS_SQL} SELECT event_id, (event_id % 3 = 0 OR dts >= 1704100000000000) AND (event_id % 5 = 0 OR dts < 1705000000000000) AS active FROM p")
def time_window(spark, sf_dir):
    p = packets(spark, sf_dir)
    start, end = F.when(F.col("event_id") % 3 != 0, F.lit(1704100000000000)), F.when(F.col("event_id") % 5 != 0, F.lit(1705000000000000))
    return p.select("event_id", pw.is_active(F.col("dts"), start, end).alias("active"))


@query("composition_offset", f"WITH {PACKETS_SQL} SELECT event_id, event_id % 7 * 40 AS shift FROM p")
def composition_offset(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("pts", F.col("dts") + F.col("event_id") % 7 * 40)
    return p.select("event_id", pk.composition_offset(F.col("pts"), F.col("dts")).alias("shift"))


@query("track_summary", f"""WITH {PACKETS_SQL} SELECT source_id, track_id, count(*) AS n_packets, count(*) FILTER (WHERE is_keyframe) AS n_keyframes, max(pts + event_id % 50 * 1000) AS "end" FROM p GROUP BY source_id, track_id""")
def track_summary(spark, sf_dir):
    return pk.file_fields(packets(spark, sf_dir).withColumn("duration", F.col("event_id") % 50 * 1000))


@query("mix_lengths", """WITH l AS (SELECT n_nationkey, n_nationkey * 13 % 50 + 1 AS a, n_nationkey * 29 % 70 + 1 AS b FROM nation)
    SELECT n_nationkey, greatest(a, b) AS longest, least(a, b) AS shortest, a AS first, CAST(44 AS BIGINT) AS fixed, b AS shortest_looped FROM l""")
def mix_lengths(spark, sf_dir):
    """The length rules for two inputs, the first of them looped in the last column."""

    def run(batches):
        for pdf in batches:
            pairs = list(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True))
            for rule in ("longest", "shortest", "first", "fixed"):
                pdf[rule] = [align.length_rule(list(p), rule, 44) for p in pairs]
            pdf["shortest_looped"] = [align.length_rule([None, b], "shortest") for _, b in pairs]
            yield pdf[["n_nationkey", "longest", "shortest", "first", "fixed", "shortest_looped"]]

    k = F.col("n_nationkey").cast("long")
    rows = read(spark, sf_dir, "nation").select("n_nationkey", (k * 13 % 50 + 1).alias("a"), (k * 29 % 70 + 1).alias("b"))
    kind = rows.schema["n_nationkey"].dataType.simpleString()
    return rows.mapInPandas(run, f"n_nationkey {kind}, longest long, shortest long, first long, fixed long, shortest_looped long")


@query("speech_downmix", f"""WITH {stereo_sql()}, m AS (SELECT clip_id, frame, sum(CAST(sample AS DOUBLE) * 0.5) / 32768 AS v FROM t GROUP BY ALL) SELECT clip_id, frame, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS value FROM m""")
def speech_downmix(spark, sf_dir):
    """Stereo floats at 16 kHz to the mono that speech models take; the rate is right already."""
    rows = stereo(spark, sf_dir).select("clip_id", "frame", "channel", (F.col("sample") / F.lit(32768.0)).cast("float").alias("value"))
    return sequence.downmix_for_speech(rows, 2, 16000).select("clip_id", "frame", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("overlap_slices", f"""{S}, n AS (SELECT clip_id, max(frame) + 1 AS n FROM s GROUP BY clip_id), b AS (SELECT clip_id, n, unnest(range(0, n, 10)) AS start FROM n)
    SELECT b.clip_id, b.start // 10 AS block, s.frame - greatest(b.start, 4) AS place, sample FROM b JOIN s ON s.clip_id = b.clip_id AND s.frame >= greatest(b.start, 4) AND s.frame < least(b.start + 10, 25)""")
def overlap_slices(spark, sf_dir):
    """The part [4, 25) of each clip as it lies in blocks of ten frames."""
    return align.block_slices(samples(spark, sf_dir), 10, 4, 25).select("clip_id", "block", "place", "sample")
