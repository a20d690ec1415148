"""Queries on single samples, and on clips aligned by position."""

from pyspark.sql import functions as F

from wavelattice.operators import align, analysis
from wavelattice.operators import pointwise as pw
from wavelattice.plans.registry import query
from wavelattice.plans.tables import read, samples, samples_sql, stereo, stereo_sql

S = f"WITH {samples_sql()}"
ST = f"WITH {stereo_sql()}"
_CUT = "CAST(trunc(greatest(least({x}, 32767.0), -32768.0)) AS INTEGER)"
_RND = "CAST(greatest(least(round_even({x}, 0), 32767), -32768) AS INTEGER)"


@query("gain", f"{S} SELECT clip_id, frame, {_CUT.format(x='CAST(sample AS DOUBLE) * 0.37')} AS sample FROM s")
def gain(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("sample", pw.gain(F.col("sample"), 0.37, 16))


@query("gain_clamp16", f"{S} SELECT clip_id, frame, {_CUT.format(x='CAST(sample AS DOUBLE) * 3.5')} AS sample FROM s")
def gain_clamp16(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("sample", pw.gain(F.col("sample"), 3.5, 16))


@query("gain_zero_and_one", f"{S} SELECT clip_id, frame, 0 AS muted, sample AS same FROM s")
def gain_zero_and_one(spark, sf_dir):
    x = F.col("sample")
    return samples(spark, sf_dir).select("clip_id", "frame", pw.gain(x, 0.0, 16).alias("muted"), pw.gain(x, 1.0, 16).alias("same"))


@query(
    "bit_depth_narrow",
    f"{S} SELECT clip_id, frame, CAST(greatest(least(CASE WHEN sample < 0 THEN -((-sample + 128) // 256) ELSE (sample + 128) // 256 END, 127), -128) AS INTEGER) AS sample FROM s",
)
def bit_depth_narrow(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("sample", pw.rescale_bits(F.col("sample"), 16, 8))


@query("bit_depth_widen", f"{S} SELECT clip_id, frame, CAST(sample * 256 AS INTEGER) AS sample FROM s")
def bit_depth_widen(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("sample", pw.rescale_bits(F.col("sample"), 16, 24))


_E = """WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS frame FROM embeddings)"""


def _values(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("frame", "x"))


@query("float_to_pcm32", f"{_E} SELECT vec_id, CAST(frame AS BIGINT) AS frame, CAST(trunc(greatest(least(CAST(x AS DOUBLE) * 4, 1.0), -1.0) * 2147483647.0) AS INTEGER) AS sample FROM v")
def float_to_pcm32(spark, sf_dir):
    return _values(spark, sf_dir).select("vec_id", F.col("frame").cast("long").alias("frame"), pw.float_to_int32(F.col("x").cast("double") * 4).alias("sample"))


@query("float_to_int16", f"{_E} SELECT vec_id, CAST(frame AS BIGINT) AS frame, CAST(greatest(least(round_even(CAST(x AS DOUBLE) * 4 * 32767.0, 0), 32767), -32768) AS INTEGER) AS sample FROM v")
def float_to_int16(spark, sf_dir):
    return _values(spark, sf_dir).select("vec_id", F.col("frame").cast("long").alias("frame"), pw.float_to_int16(F.col("x").cast("double") * 4).alias("sample"))


@query("pan_linear", f"{ST} SELECT clip_id, frame, channel, {_CUT.format(x='CAST(sample AS DOUBLE) * CASE WHEN channel = 0 THEN 0.75 ELSE 1.0 END')} AS sample FROM t")
def pan_linear(spark, sf_dir):
    return stereo(spark, sf_dir).withColumn("sample", pw.pan(F.col("sample"), F.col("channel"), 0.25, 16))


@query("pan_equal_power", f"{ST} SELECT clip_id, frame, channel, {_CUT.format(x='CAST(sample AS DOUBLE) * CASE WHEN channel = 0 THEN cos(1.25 * pi() / 4) ELSE sin(1.25 * pi() / 4) END')} AS sample FROM t")
def pan_equal_power(spark, sf_dir):
    return stereo(spark, sf_dir).withColumn("sample", pw.pan(F.col("sample"), F.col("channel"), 0.25, 16, "equal_power"))


@query(
    "fade_linear",
    f"""{S}, n AS (SELECT clip_id, max(frame) + 1 AS total FROM s GROUP BY clip_id),
    g AS (SELECT clip_id, frame, sample, least(CASE WHEN frame < 8 THEN frame / 8.0::DOUBLE ELSE 1.0 END,
      CASE WHEN frame >= total - 16 THEN greatest(least((total - 1 - frame) / 16.0::DOUBLE, 1.0), 0.0) ELSE 1.0 END) AS g FROM s JOIN n USING (clip_id))
    SELECT clip_id, frame, CAST(round_even(CAST(sample AS DOUBLE) * g, 0) AS INTEGER) AS sample FROM g""",
)
def fade_linear(spark, sf_dir):
    s = samples(spark, sf_dir)
    total = s.groupBy("clip_id").agg((F.max("frame") + 1).alias("total"))
    return s.join(total, "clip_id").select("clip_id", "frame", pw.fade(F.col("sample"), F.col("frame"), F.col("total"), 8, 16).alias("sample"))


@query(
    "fade_equal_power",
    f"""{S} SELECT clip_id, frame, round(CASE WHEN frame < 20 THEN sin(frame / 20.0::DOUBLE * pi() / 2) ELSE 1.0 END, 6) AS g FROM s""",
)
def fade_equal_power(spark, sf_dir):
    return samples(spark, sf_dir).select("clip_id", "frame", F.round(pw.fade_gain(F.col("frame"), F.lit(0), 20, 0, "equal_power"), 6).alias("g"))


@query("channel_remix_down", f"{ST} SELECT clip_id, frame, 0 AS channel, CAST(round_even(sum(CAST(sample AS DOUBLE) * 0.5), 0) AS INTEGER) AS sample FROM t GROUP BY clip_id, frame")
def channel_remix_down(spark, sf_dir):
    return pw.remix(stereo(spark, sf_dir), 2, 1)


@query("channel_remix_up", f"{ST} SELECT clip_id, frame, o.channel AS channel, sample FROM t JOIN (VALUES (0), (1), (2), (3)) o(channel) ON t.channel = o.channel % 2")
def channel_remix_up(spark, sf_dir):
    return pw.remix(stereo(spark, sf_dir), 2, 4)


@query("cut_range", f"{S} SELECT clip_id, frame - 10 AS frame, sample FROM s WHERE frame >= 10 AND frame < 40")
def cut_range(spark, sf_dir):
    return align.cut(samples(spark, sf_dir), 1, 4, 10)


@query(
    "concat",
    f"""WITH {samples_sql("event_type")}, n AS (SELECT clip_id, max(frame) + 1 AS n FROM s GROUP BY clip_id),
    o AS (SELECT clip_id, coalesce(sum(n) OVER (ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n)
    SELECT 'all' AS clip_id, CAST(frame + base AS BIGINT) AS frame, sample FROM s JOIN o USING (clip_id)""",
)
def concat(spark, sf_dir):
    parts = samples(spark, sf_dir, "event_type").withColumnRenamed("clip_id", "part")
    return align.concat_parts(parts, "part", F.lit("all")).select("clip_id", "frame", "sample")


@query(
    "mix",
    f"""{S}, u AS (SELECT clip_id, frame, CAST(sample AS DOUBLE) * 0.5 AS x FROM s UNION ALL SELECT clip_id, frame + 7, CAST(sample AS DOUBLE) * 0.25 FROM s)
    SELECT clip_id, frame, {_RND.format(x='sum(x)')} AS sample FROM u GROUP BY clip_id, frame""",
)
def mix(spark, sf_dir):
    s = samples(spark, sf_dir)
    return align.mix([(s, 0.5), (s.withColumn("frame", F.col("frame") + 7), 0.25)], 16)


@query(
    "mix_offset_loop",
    f"""{S}, n AS (SELECT clip_id, max(frame) + 1 AS n FROM s GROUP BY clip_id),
    u AS (SELECT clip_id, f.frame AS frame, CAST(sample AS DOUBLE) * 0.5 AS x FROM n JOIN (SELECT unnest(range(100)) AS frame) f ON f.frame >= 5
      JOIN s USING (clip_id) WHERE s.frame = (f.frame - 5) % n.n
      UNION ALL SELECT clip_id, frame, CAST(sample AS DOUBLE) FROM s WHERE frame < 100)
    SELECT clip_id, frame, round(sum(x), 6) AS sample FROM u GROUP BY clip_id, frame""",
)
def mix_offset_loop(spark, sf_dir):
    s = samples(spark, sf_dir)
    return align.mix_float([(s, 0.5, 5, True), (s, 1.0, 0, False)], 100).withColumn("sample", F.round("sample", 6))


@query(
    "peak_normalize",
    f"""{S}, g AS (SELECT clip_id, pow(10, -1 / 20.0::DOUBLE) * 32767 / max(abs(CAST(sample AS BIGINT))) AS g FROM s GROUP BY clip_id HAVING max(abs(sample)) > 0)
    SELECT clip_id, frame, {_CUT.format(x='CAST(sample AS DOUBLE) * g')} AS sample FROM s JOIN g USING (clip_id)""",
)
def peak_normalize(spark, sf_dir):
    return analysis.peak_normalize(samples(spark, sf_dir), -1.0, 16)


_A = "SELECT code, xor(code, 85) AS a FROM (SELECT DISTINCT CAST(user_id % 256 AS INTEGER) AS code FROM events)"


@query(
    "alaw_expand",
    f"""WITH c AS ({_A}), m AS (SELECT code, a, CASE WHEN (a & 112) = 0 THEN ((a & 15) * 2 + 1) * 8 ELSE ((a & 15) * 2 + 33) << (((a & 112) >> 4) + 2) END AS m FROM c)
    SELECT code, CAST(CASE WHEN (a & 128) <> 0 THEN m ELSE -m END AS INTEGER) AS sample FROM m""",
)
def alaw_expand(spark, sf_dir):
    codes = read(spark, sf_dir, "events").select((F.col("user_id") % 256).cast("int").alias("code")).distinct()
    return codes.withColumn("sample", pw.alaw_expand(F.col("code")))


@query(
    "mulaw_expand",
    """WITH c AS (SELECT DISTINCT CAST(user_id % 256 AS INTEGER) AS code FROM events), u AS (SELECT code, 255 - code AS u FROM c),
    m AS (SELECT code, u, ((u & 15) * 8 + 132) << ((u & 112) >> 4) AS m FROM u)
    SELECT code, CAST(CASE WHEN (u & 128) <> 0 THEN 132 - m ELSE m - 132 END AS INTEGER) AS sample FROM m""",
)
def mulaw_expand(spark, sf_dir):
    codes = read(spark, sf_dir, "events").select((F.col("user_id") % 256).cast("int").alias("code")).distinct()
    return codes.withColumn("sample", pw.mulaw_expand(F.col("code")))


_RGB = "WITH c AS (SELECT p_partkey, CAST(p_partkey % 256 AS INTEGER) AS r, CAST(p_partkey * 7 % 256 AS INTEGER) AS g, CAST(p_size * 5 % 256 AS INTEGER) AS b FROM part)"


def _rgb(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_partkey") % 256).cast("int").alias("r"), (F.col("p_partkey") * 7 % 256).cast("int").alias("g"), (F.col("p_size") * 5 % 256).cast("int").alias("b")
    )


@query(
    "rgb_to_yuv",
    f"""{_RGB}, y AS (SELECT *, 0.299::DOUBLE * (r / 255.0::DOUBLE) + (1 - 0.299::DOUBLE - 0.114::DOUBLE) * (g / 255.0::DOUBLE) + 0.114::DOUBLE * (b / 255.0::DOUBLE) AS l FROM c)
    SELECT p_partkey, CAST(round(16 + 219.0::DOUBLE * l) AS INTEGER) AS y,
      CAST(round(128 + 224.0::DOUBLE * ((b / 255.0::DOUBLE - l) / (2 * (1 - 0.114::DOUBLE)))) AS INTEGER) AS cb,
      CAST(round(128 + 224.0::DOUBLE * ((r / 255.0::DOUBLE - l) / (2 * (1 - 0.299::DOUBLE)))) AS INTEGER) AS cr FROM y""",
)
def rgb_to_yuv(spark, sf_dir):
    y, cb, cr = pw.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(spark, sf_dir).select("p_partkey", y.alias("y"), cb.alias("cb"), cr.alias("cr"))


@query(
    "waveform_windows",
    f"""WITH {samples_sql("event_type")}, n AS (SELECT clip_id, greatest((max(frame) + 1) // 200, 1) AS w FROM s GROUP BY clip_id)
    SELECT clip_id, CAST(frame // w AS BIGINT) AS "window", max(abs(CAST(sample AS BIGINT))) / 32768.0::DOUBLE AS peak FROM s JOIN n USING (clip_id) GROUP BY ALL""",
)
def waveform_windows(spark, sf_dir):
    return analysis.waveform(samples(spark, sf_dir, "event_type"), 16)


@query("plain_subtitle", r"""SELECT item_id, regexp_replace(concat('{\an8}', text, '\Nx{\b1}y'), '\{[^}]*\}', '', 'g').replace('\N', chr(10)).replace('\h', chr(160)).replace('\n', ' ') AS text FROM benchmark""")
def plain_subtitle(spark, sf_dir):
    raw = F.concat(F.lit("{\\an8}"), F.col("text"), F.lit("\\Nx{\\b1}y"))
    return read(spark, sf_dir, "benchmark").select("item_id", pw.plain_subtitle(raw).alias("text"))


@query(
    "crossfade_pixels",
    """SELECT p_partkey, CAST(((p_partkey % 256) * (256 - 77) + (p_size * 5 % 256) * 77 + 128) >> 8 AS INTEGER) AS value,
    CAST(((p_partkey % 256) * (255 - p_size) + (p_size * 5 % 256) * p_size + 127) // 255 AS INTEGER) AS over FROM part""",
)
def crossfade_pixels(spark, sf_dir):
    r, b = (F.col("p_partkey") % 256).cast("int"), (F.col("p_size") * 5 % 256).cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", align.crossfade(r, b, 77).alias("value"), align.composite(r, b, F.col("p_size")).alias("over"))

