"""Queries on packets, frames, segments and playlists."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavelattice.operators import align, packets as pk
from wavelattice.plans.registry import query
from wavelattice.plans.tables import PACKETS_SQL, micros, packets, read

P = f"WITH {PACKETS_SQL}"
PR = f"WITH RECURSIVE {PACKETS_SQL}"


def _rescale_sql(v, s, t):
    p = f"(CAST({v} AS HUGEINT) * {t})"
    r = f"(abs({p}) % {s})"
    w = f"((abs({p}) - {r}) // {s})"
    return f"CAST((CASE WHEN {p} < 0 THEN -1 ELSE 1 END) * ({w} + CASE WHEN {r} * 2 > {s} OR ({r} * 2 = {s} AND {w} % 2 <> 0) THEN 1 ELSE 0 END) AS BIGINT)"


@query("timestamp_rescale", f"{P} SELECT event_id, {_rescale_sql('dts', 1000000, 90000)} AS at_90k, {_rescale_sql('event_id - 5000', 8, 12)} AS small FROM p")
def timestamp_rescale(spark, sf_dir):
    return packets(spark, sf_dir).select("event_id", pk.rescale(F.col("dts"), 1000000, 90000).alias("at_90k"), pk.rescale(F.col("event_id") - 5000, 8, 12).alias("small"))


@query("frame_slots", f"{P}, f AS (SELECT event_id, dts - min(dts) OVER () AS t FROM p) SELECT event_id, CAST((t * 60000 * 2 + 1001000000) // (2 * 1001000000) AS BIGINT) AS slot FROM f")
def frame_slots(spark, sf_dir):
    p = packets(spark, sf_dir)
    first = p.agg(F.min("dts").alias("first"))
    return p.join(F.broadcast(first)).select("event_id", pk.frame_slot(F.col("dts") - F.col("first"), 60000, 1001, 1_000_000).alias("slot"))


@query("packet_durations", f"""{P} SELECT event_id, coalesce(lead(dts) OVER w - dts, dts - lag(dts) OVER w, 33333) AS duration FROM p WINDOW w AS (PARTITION BY track_id ORDER BY dts, event_id)""")
def packet_durations(spark, sf_dir):
    return pk.durations(packets(spark, sf_dir), 33333, ("dts", "event_id")).select("event_id", "duration")


@query("presentation_end", f"""{P}, d AS (SELECT *, coalesce(lead(dts) OVER w - dts, dts - lag(dts) OVER w, 33333) AS duration FROM p WINDOW w AS (PARTITION BY track_id ORDER BY dts, event_id))
    SELECT source_id, track_id, max(pts + duration) AS presentation_end, count(*) AS n_packets FROM d GROUP BY ALL""")
def presentation_end(spark, sf_dir):
    return pk.presentation_end(pk.durations(packets(spark, sf_dir), 33333, ("dts", "event_id")))


# Two tracks of one source: conversations' turns in milliseconds and in 1/90000 s.
_TWO = """k AS (SELECT conv_id AS source_id, CAST(turn % 2 AS INTEGER) AS track_id, turn * CASE WHEN turn % 2 = 0 THEN 40 ELSE 3003 END AS dts, turn FROM conversations)"""


def _two_tracks(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("source_id"), (F.col("turn") % 2).cast("int").alias("track_id"), (F.col("turn") * F.when(F.col("turn") % 2 == 0, 40).otherwise(3003)).alias("dts"), "turn"
    )


@query("packet_interleave", f"""WITH {_TWO} SELECT source_id, turn, row_number() OVER (PARTITION BY source_id ORDER BY dts * CASE WHEN track_id = 0 THEN 90 ELSE 1 END, track_id, dts) - 1 AS position FROM k""")
def packet_interleave(spark, sf_dir):
    tracks = spark.createDataFrame([(0, 0, 1000, 90000), (1, 1, 90000, 90000)], "track_id int, track_no int, timescale long, common long")
    return pk.interleaved(_two_tracks(spark, sf_dir), tracks).select("source_id", "turn", F.col("position").cast("long").alias("position"))


@query("flv_unwrap", f"""{P}, r AS (SELECT event_id, track_id, dts, (dts * 41) % 4294967296 AS raw FROM p),
    d AS (SELECT event_id, track_id, raw, lag(raw) OVER (PARTITION BY track_id ORDER BY dts, event_id) AS before, dts FROM r),
    x AS (SELECT event_id, track_id, dts, coalesce(((raw - before + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, raw) AS d FROM d)
    SELECT event_id, CAST(sum(d) OVER (PARTITION BY track_id ORDER BY dts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS time FROM x""")
def flv_unwrap(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("source_id", F.col("track_id").cast("string")).withColumn("raw", F.col("dts") * 41 % (1 << 32))
    return pk.unwrap32(p, "raw", ["dts", "event_id"]).select("event_id", "time")


_ARRIVALS = """a AS (SELECT CAST(user_id AS VARCHAR) AS source_id, CAST(row_number() OVER w - 1 AS BIGINT) AS arrival, CAST((row_number() OVER w - 1) * 100 + (CASE (row_number() OVER w - 1) % 4 WHEN 1 THEN 200 WHEN 2 THEN -100 WHEN 3 THEN -100 ELSE 0 END) AS BIGINT) AS pts
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("dts_reconstruct", f"""WITH {_ARRIVALS}, z AS (SELECT source_id, pts, row_number() OVER (PARTITION BY source_id ORDER BY pts) - 1 AS k FROM a),
    m AS (SELECT a.source_id, arrival, a.pts, z.pts AS sorted FROM a JOIN z ON a.source_id = z.source_id AND z.k = a.arrival),
    s AS (SELECT source_id, greatest(max(sorted - pts), 0) AS shift FROM m WHERE arrival <= 16 GROUP BY source_id)
    SELECT source_id, arrival, pts, sorted - shift AS dts FROM m JOIN s USING (source_id)""")
def dts_reconstruct(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.row_number().over(w) - 1
    moved = F.when(k % 4 == 1, 200).when(k % 4 >= 2, -100).otherwise(0)
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), k.cast("long").alias("arrival"), (k * 100 + moved).cast("long").alias("pts"))
    return pk.reconstruct_dts(rows)


@query("frame_rate_change", f"""{P}, f AS (SELECT track_id, event_id, dts - min(dts) OVER (PARTITION BY track_id) AS t FROM p),
    s AS (SELECT track_id, event_id, t, (t * 2 + 3600000000) // 7200000000 AS slot FROM f), l AS (SELECT *, row_number() OVER (PARTITION BY track_id, slot ORDER BY t DESC, event_id DESC) AS r FROM s),
    n AS (SELECT track_id, event_id, slot, coalesce(lead(slot) OVER (PARTITION BY track_id ORDER BY slot), slot + 1) AS nx FROM l WHERE r = 1)
    SELECT CAST(track_id AS VARCHAR) AS clip_id, CAST(unnest(range(slot, nx)) AS BIGINT) AS out_frame, event_id AS frame_no FROM n""")
def frame_rate_change(spark, sf_dir):
    frames = packets(spark, sf_dir).select(F.col("track_id").cast("string").alias("clip_id"), F.col("event_id").alias("frame_no"), F.col("dts").alias("ts"))
    return pk.change_frame_rate(frames, 1, 3600, 1_000_000)


@query("keyframe_seek", f"""{P}, t AS (SELECT track_id, CAST(min(pts) + (max(pts) - min(pts)) // 2 AS BIGINT) AS target FROM p GROUP BY track_id)
    SELECT track_id, target, coalesce(max(CASE WHEN is_keyframe AND pts <= target THEN pts END), min(pts)) AS start_pts FROM p JOIN t USING (track_id) GROUP BY ALL""")
def keyframe_seek(spark, sf_dir):
    p = packets(spark, sf_dir)
    targets = p.groupBy("track_id").agg(F.expr("min(pts) + (max(pts) - min(pts)) div 2").alias("target"))
    return align.keyframe_seek(p, targets)


_MID = "1704412800000000"


@query("split_keyframes", f"""{P}, m AS (SELECT min(track_id) AS t FROM p), k AS (SELECT min(pts) AS c FROM p, m WHERE track_id = t AND is_keyframe AND pts >= {_MID})
    SELECT event_id, CAST(CASE WHEN c <= pts THEN 1 ELSE 0 END AS INTEGER) AS part, pts - CASE WHEN c <= pts THEN c ELSE 0 END AS part_pts FROM p, k""")
def split_keyframes(spark, sf_dir):
    p = packets(spark, sf_dir)
    track = p.agg(F.min("track_id")).first()[0]
    return pk.split_at_keyframes(p, track, [int(_MID)]).select("event_id", "part", "part_pts")


_SEG = """, k AS (SELECT CAST(track_id AS VARCHAR) AS source_id, pts, dts, is_keyframe, row_number() OVER (PARTITION BY track_id ORDER BY dts, event_id) AS i FROM p),
    f AS (SELECT source_id, min(i) AS f FROM k WHERE is_keyframe GROUP BY source_id),
    g AS (SELECT k.source_id, k.i, k.pts AS start, false AS cut, CAST(NULL AS BIGINT) AS was, 1 AS n FROM k JOIN f ON k.source_id = f.source_id AND k.i = f.f
      UNION ALL SELECT k.source_id, k.i, CASE WHEN k.is_keyframe AND k.pts - g.start >= 432000000000 THEN k.pts ELSE g.start END, k.is_keyframe AND k.pts - g.start >= 432000000000, g.start,
        g.n + CASE WHEN k.is_keyframe AND k.pts - g.start >= 432000000000 THEN 1 ELSE 0 END FROM g JOIN k ON k.source_id = g.source_id AND k.i = g.i + 1),
    e AS (SELECT source_id, max(pts) AS m, max(dts) - max(CASE WHEN i < n THEN dts END) AS step FROM (SELECT k.*, max(i) OVER (PARTITION BY k.source_id) AS n FROM k JOIN f ON k.source_id = f.source_id WHERE i >= f) GROUP BY source_id),
    o AS (SELECT source_id, CAST(n - 1 AS BIGINT) AS sequence, was AS start_pts, (start - was) / 1000000.0::DOUBLE AS duration_s FROM g WHERE cut
      UNION ALL SELECT g.source_id, CAST(max(n) AS BIGINT), max(start), (max(m) + max(coalesce(step, 1)) - max(start)) / 1000000.0::DOUBLE FROM g JOIN e USING (source_id) GROUP BY g.source_id)"""


@query("hls_segment", f"{PR}{_SEG} SELECT source_id, sequence, start_pts, round(duration_s, 6) AS duration_s FROM o")
def hls_segment(spark, sf_dir):
    out = pk.segments(_per_user(spark, sf_dir), 0, 432_000, 1_000_000, ("dts", "event_id"), 1)
    return out.select("source_id", "sequence", "start_pts", F.round("duration_s", 6).alias("duration_s"))


def _per_user(spark, sf_dir):
    return packets(spark, sf_dir).withColumn("source_id", F.col("track_id").cast("string")).withColumn("track_id", F.lit(0))


_CHANGE = """, k AS (SELECT CAST(track_id AS VARCHAR) AS source_id, pts, dts, is_keyframe AS key, config_version AS ver, row_number() OVER (PARTITION BY track_id ORDER BY dts, event_id) AS i FROM p),
    g AS (SELECT source_id, i, ver, CASE WHEN key THEN pts END AS start, CASE WHEN key THEN pts END AS mx, CAST(NULL AS BIGINT) AS step, CASE WHEN key THEN dts END AS pd, 1 AS n, false AS broken,
        CAST(NULL AS INTEGER) AS en, CAST(NULL AS BIGINT) AS es, CAST(NULL AS BIGINT) AS ee, false AS eb FROM k WHERE i = 1
      UNION ALL SELECT source_id, i, ver, s2, CASE WHEN s2 IS NULL THEN mx1 ELSE greatest(coalesce(mx1, pts), pts) END, CASE WHEN s2 IS NULL OR pd1 IS NULL THEN st1 ELSE greatest(dts - pd1, 1) END,
        CASE WHEN s2 IS NULL THEN pd1 ELSE dts END, n1 + CASE WHEN cut THEN 1 ELSE 0 END, CASE WHEN cut THEN false ELSE b1 END,
        CASE WHEN chg THEN n0 WHEN cut THEN n1 END, CASE WHEN chg THEN s0 WHEN cut THEN s1 END, CASE WHEN chg THEN mx0 + coalesce(st0, 1) WHEN cut THEN pts END, CASE WHEN chg THEN b0 ELSE b1 END
        FROM (SELECT *, coalesce(key AND s1 IS NOT NULL AND pts - s1 >= 432000000000, false) AS cut, CASE WHEN key AND (s1 IS NULL OR pts - s1 >= 432000000000) THEN pts ELSE s1 END AS s2
          FROM (SELECT *, CASE WHEN chg THEN NULL ELSE s0 END AS s1, CASE WHEN chg THEN NULL ELSE mx0 END AS mx1, CASE WHEN chg THEN NULL ELSE st0 END AS st1, CASE WHEN chg THEN NULL ELSE pd0 END AS pd1,
              n0 + CASE WHEN chg THEN 1 ELSE 0 END AS n1, chg OR b0 AS b1
            FROM (SELECT k.*, g.start AS s0, g.mx AS mx0, g.step AS st0, g.pd AS pd0, g.n AS n0, g.broken AS b0, k.ver <> g.ver AND g.start IS NOT NULL AS chg FROM g JOIN k ON k.source_id = g.source_id AND k.i = g.i + 1)))),
    o AS (SELECT source_id, en AS sequence, es AS start_pts, ee AS stop, eb AS discontinuity FROM g WHERE en IS NOT NULL
      UNION ALL SELECT source_id, n, start, mx + coalesce(step, 1), broken FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY i DESC) AS r FROM g) WHERE r = 1 AND start IS NOT NULL)"""


@query("hls_config_change", f"{PR}{_CHANGE} SELECT source_id, CAST(sequence AS BIGINT) AS sequence, start_pts, round((stop - start_pts) / 1000000.0::DOUBLE, 6) AS duration_s, discontinuity FROM o")
def hls_config_change(spark, sf_dir):
    return pk.segments(_per_user(spark, sf_dir), 0, 432_000, 1_000_000, ("dts", "event_id"), 1, breaks="config_version").withColumn("duration_s", F.round("duration_s", 6))


@query("hls_two_tracks", f"{PR}{_SEG} SELECT source_id, sequence, start_pts, round(duration_s, 6) AS duration_s, false AS discontinuity FROM o")
def hls_two_tracks(spark, sf_dir):
    """Video and audio whose versions differ but never change: the segments of the video alone, none discontinuous."""
    video = _per_user(spark, sf_dir).withColumn("config_version", F.lit(5))
    audio = video.withColumn("track_id", F.lit(1)).withColumn("config_version", F.lit(9)).withColumn("is_keyframe", F.lit(True))
    out = pk.segments(video.unionByName(audio), 0, 432_000, 1_000_000, ("dts", "event_id", "track_id"), 1, breaks="config_version")
    return out.withColumn("duration_s", F.round("duration_s", 6))


@query("retain_newest", f"{PR}{_SEG}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sequence DESC) AS r FROM o) SELECT source_id, sequence FROM r WHERE r <= 2")
def retain_newest(spark, sf_dir):
    return pk.retain_newest(hls_segment(spark, sf_dir), 2).select("source_id", "sequence")


@query("frame_segments", """WITH RECURSIVE c AS (SELECT CAST(conv_id AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS n FROM conversations),
    g AS (SELECT source_id, i, n AS total, 1 AS k, 1 AS seq, n >= 400 AS cut FROM c WHERE i = 1
      UNION ALL SELECT c.source_id, c.i, CASE WHEN g.cut THEN c.n ELSE g.total + c.n END, CASE WHEN g.cut THEN 1 ELSE g.k + 1 END, CASE WHEN g.cut THEN g.seq + 1 ELSE g.seq END,
        CASE WHEN g.cut THEN c.n ELSE g.total + c.n END >= 400 FROM g JOIN c ON c.source_id = g.source_id AND c.i = g.i + 1)
    SELECT source_id, CAST(seq AS BIGINT) AS sequence, CAST(max(k) AS BIGINT) AS n_frames, max(total) / 100.0::DOUBLE AS duration_s FROM g GROUP BY ALL""")
def frame_segments(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_id"), "turn", F.length("text").cast("long").alias("sample_count"))
    return pk.frame_segments(c, 100, 4.0, ("turn",))


@query("gap_fill", """WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS source_id, event_id, epoch_us(ts) AS t, CAST(floor(value) AS BIGINT) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    g AS (SELECT source_id, event_id, i, t AS origin, CAST(0 AS BIGINT) AS fill, n AS so_far FROM c WHERE i = 1
      UNION ALL SELECT c.source_id, c.event_id, c.i, g.origin, CASE WHEN (c.t - g.origin) * 10 // 1000000 - g.so_far > 1 THEN (c.t - g.origin) * 10 // 1000000 - g.so_far ELSE 0 END,
        g.so_far + c.n + CASE WHEN (c.t - g.origin) * 10 // 1000000 - g.so_far > 1 THEN (c.t - g.origin) * 10 // 1000000 - g.so_far ELSE 0 END FROM g JOIN c ON c.source_id = g.source_id AND c.i = g.i + 1)
    SELECT source_id, event_id, fill AS fill_frames FROM g""")
def gap_fill(spark, sf_dir):
    return pk.fill_gaps(captures(spark, sf_dir), 10, 0.1, ("ts_us", "event_id")).select("source_id", "event_id", "fill_frames")


def captures(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), micros("ts").alias("ts_us"), F.floor("value").cast("long").alias("n_frames"), "event_id")


@query("order_validation", f"""{P}, v AS (SELECT event_id, CASE WHEN event_id % 7 > 3 THEN 'pts before dts'
      WHEN lag(dts) OVER (PARTITION BY track_id ORDER BY event_id) >= dts THEN 'dts not increasing' END AS violation FROM p) SELECT event_id, violation FROM v""")
def order_validation(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("pts", F.col("dts") - F.when(F.col("event_id") % 7 > 3, 1).otherwise(0))
    return pk.invalid_order(p, ("event_id",)).select("event_id", "violation")


@query("track_lookup", """SELECT n_nationkey AS track_id, n_name AS name, r_name AS kind FROM nation JOIN region ON n_regionkey = r_regionkey""")
def track_lookup(spark, sf_dir):
    tracks = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("kind"))
    found = pk.find_track(read(spark, sf_dir, "nation"), tracks, "n_regionkey")
    return found.select(F.col("n_nationkey").alias("track_id"), F.col("n_name").alias("name"), "kind")


@query("codecs_string", """WITH k AS (SELECT DISTINCT n_regionkey AS source_id, CASE WHEN n_nationkey % 3 = 0 THEN 'avc1' ELSE 'mp4a' END AS codec FROM nation)
    SELECT source_id, string_agg(codec, ',' ORDER BY codec) AS codecs FROM k GROUP BY source_id""")
def codecs_string(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    video = F.col("n_nationkey") % 3 == 0
    tracks = n.select(F.col("n_regionkey").alias("source_id"), F.col("n_nationkey").alias("track_id"), F.when(video, "video").otherwise("audio").alias("kind"), F.when(video, "avc1").otherwise("mp4a").alias("codec"))
    return pk.codecs_string(tracks)


@query("sample_times", """WITH r AS (SELECT CAST(p_size AS INTEGER) AS track_id, p_partkey AS entry, p_partkey % 5 AS n_samples, p_partkey % 11 + 1 AS delta FROM part),
    b AS (SELECT *, coalesce(sum(n_samples) OVER w, 0) AS s, coalesce(sum(n_samples * delta) OVER w, 0) AS t FROM r WINDOW w AS (PARTITION BY track_id ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT track_id, CAST(s + k AS BIGINT) AS sample_no, CAST(t + k * delta AS BIGINT) AS dts, delta AS duration FROM (SELECT *, unnest(range(n_samples)) AS k FROM b)""")
def sample_times(spark, sf_dir):
    runs = read(spark, sf_dir, "part").select(
        F.col("p_size").alias("track_id"), F.col("p_partkey").alias("entry"), (F.col("p_partkey") % 5).alias("n_samples"), (F.col("p_partkey") % 11 + 1).alias("delta")
    )
    return pk.sample_times(runs)


@query("join_offsets", "SELECT n_nationkey AS file_no, CAST(n_nationkey * 37 + 5 AS BIGINT) AS length, CAST(coalesce(sum(n_nationkey * 37 + 5) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM nation")
def join_offsets(spark, sf_dir):
    return pk.join_offsets(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_no"), (F.col("n_nationkey") * 37 + 5).cast("long").alias("length")))
