"""Queries on file headers, playlists, layouts and pixels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavelattice.operators import align, analysis, packets as pk
from wavelattice.operators import pointwise as pw
from wavelattice.plans.registry import query
from wavelattice.plans.streams import PR, _SEG, hls_segment
from wavelattice.plans.tables import PACKETS_SQL, packets, read, samples, samples_sql
from wavelattice.sources import sniff

P = f"WITH {PACKETS_SQL}"
_HEADS = ("524946460000000057415645", "664C6143", "464C5601", "4F67675300000000", "494433", "0000001866747970", "FFFB9064", "FFF15080", "2E736E64", "00")
_NAMES = ("wav", "flac", "flv", "ogg", "mp3", "mp4", "mp3", "aac", "au", None)


@query("sniff_format", "SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES) if n) + " END AS extension FROM documents")
def sniff_format(spark, sf_dir):
    head = F.get(F.array(*[F.unhex(F.lit(h)) for h in _HEADS]), (F.col("doc_id") % 10).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", sniff.extension(F.concat(head, F.encode(F.col("source"), "UTF-8"))).alias("extension"))


@query("mpeg_header", """WITH h AS (SELECT event_id, CAST(4292870144 AS BIGINT) + (event_id * 7919) % 2097152 AS h FROM events),
    f AS (SELECT event_id, (h >> 19) & 3 AS v, (h >> 17) & 3 AS l, (h >> 12) & 15 AS b, (h >> 10) & 3 AS r, (h >> 6) & 3 AS m FROM h)
    SELECT event_id, v <> 1 AND l <> 0 AND b <> 15 AND r <> 3 AS valid, CAST(4 - l AS INTEGER) AS layer, CAST(b AS INTEGER) AS bitrate_index,
      CAST(CASE WHEN r = 3 THEN NULL ELSE trunc(CASE r WHEN 0 THEN 44100 WHEN 1 THEN 48000 ELSE 32000 END / CASE v WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 4 END) END AS INTEGER) AS sample_rate,
      CAST(CASE WHEN m = 3 THEN 1 ELSE 2 END AS INTEGER) AS channels FROM f""")
def mpeg_header(spark, sf_dir):
    h = F.lit(4292870144) + F.col("event_id") * 7919 % 2097152
    fields = pw.mpeg_audio_header(h)
    return read(spark, sf_dir, "events").select("event_id", *[fields[k].alias(k) for k in ("valid", "layer", "bitrate_index", "sample_rate", "channels")])


@query("audio_config", """SELECT p_partkey, CAST((w >> 11) & 31 AS INTEGER) AS object_type, CAST((w >> 3) & 15 AS INTEGER) AS channels FROM (SELECT p_partkey, p_partkey * 31 % 65536 AS w FROM part)""")
def audio_config(spark, sf_dir):
    fields = pw.audio_specific_config(F.col("p_partkey") * 31 % 65536)
    return read(spark, sf_dir, "part").select("p_partkey", fields["object_type"].alias("object_type"), fields["channels"].alias("channels"))


@query("channel_layout", """SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' WHEN 3 THEN '2.1' WHEN 4 THEN 'quad' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE n_nationkey || ' channels' END AS layout FROM nation""")
def channel_layout(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", pw.channel_layout(F.col("n_nationkey")).alias("layout"))


@query("playlist_text", f"""{PR}{_SEG}, pt AS (SELECT source_id, CAST(CAST(ceil(greatest(max(duration_s), 432000)) AS BIGINT) AS VARCHAR) AS longest, min(sequence) AS first,
    string_agg('#EXTINF:' || printf('%.6f', duration_s) || ',' || chr(10) || 'seg' || lpad(CAST(sequence AS VARCHAR), 5, '0') || '.ts', chr(10) ORDER BY sequence) AS body FROM o GROUP BY source_id)
    SELECT source_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || longest || chr(10) || '#EXT-X-MEDIA-SEQUENCE:' || first || chr(10) || body || chr(10) || '#EXT-X-ENDLIST' || chr(10) AS playlist FROM pt""")
def playlist_text(spark, sf_dir):
    segments = hls_segment(spark, sf_dir).withColumn("uri", F.format_string("seg%05d.ts", "sequence")).withColumn("discontinuity", F.lit(False))
    return pk.media_playlist(segments, 432_000)


@query("master_playlist", """SELECT n_regionkey AS source_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) ||
    string_agg('#EXT-X-STREAM-INF:BANDWIDTH=' || (n_nationkey * 1000 + 64000) || ',CODECS="avc1,mp4a"' || chr(10) || n_name || '.m3u8', chr(10) ORDER BY n_nationkey) || chr(10) AS playlist FROM nation GROUP BY n_regionkey""")
def master_playlist(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    rows = n.select(
        F.col("n_regionkey").alias("source_id"), F.col("n_nationkey").alias("order_no"), (F.col("n_nationkey") * 1000 + 64000).alias("bandwidth"), F.lit("avc1,mp4a").alias("codecs"),
        F.concat("n_name", F.lit(".m3u8")).alias("uri"),
    )
    return pk.master_playlist(rows)


@query("chunk_layout", f"""WITH RECURSIVE {PACKETS_SQL}, k AS (SELECT track_id, dts, row_number() OVER (PARTITION BY track_id ORDER BY dts, event_id) AS i FROM p),
    g AS (SELECT track_id, i, dts AS start FROM k WHERE i = 1 UNION ALL
      SELECT k.track_id, k.i, CASE WHEN k.dts - g.start >= 86400000000 THEN k.dts ELSE g.start END FROM g JOIN k ON k.track_id = g.track_id AND k.i = g.i + 1),
    c AS (SELECT track_id, start, count(*) AS n_samples FROM g GROUP BY ALL)
    SELECT CAST(track_id % 16 AS VARCHAR) AS source_id, track_id, start, n_samples, CAST(row_number() OVER (PARTITION BY track_id % 16 ORDER BY start, track_id) - 1 AS BIGINT) AS position FROM c""")
def chunk_layout(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("source_id", (F.col("track_id") % 16).cast("string"))
    return pk.chunk_layout(p, 86_400_000_000, ("dts", "event_id"))


@query("transport_order", f"""{P} SELECT event_id, dts // 3600000000 AS segment, CAST(row_number() OVER (PARTITION BY dts // 3600000000 ORDER BY dts, event_id) - 1 AS BIGINT) AS place FROM p""")
def transport_order(spark, sf_dir):
    return pk.transport_order(packets(spark, sf_dir), 3_600_000_000, "event_id").select("event_id", "segment", "place")


@query("timeline_plan", """WITH RECURSIVE s AS (SELECT CAST(conv_id AS VARCHAR) AS clip_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, CAST(length(text) % 90 AS BIGINT) AS d FROM conversations),
    e AS (SELECT *, CAST((sum(d) OVER (PARTITION BY clip_id ORDER BY i) * 30 * 2 + 1000) // 2000 AS BIGINT) AS slot FROM s),
    g AS (SELECT clip_id, i, turn, CAST(0 AS BIGINT) AS first_frame, greatest(slot, 1) AS end_frame FROM e WHERE i = 1 UNION ALL
      SELECT e.clip_id, e.i, e.turn, g.end_frame, greatest(e.slot, g.end_frame + 1) FROM g JOIN e ON e.clip_id = g.clip_id AND e.i = g.i + 1)
    SELECT clip_id, turn AS scene_no, first_frame, end_frame FROM g""")
def timeline_plan(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return pk.timeline(c.select(F.col("conv_id").cast("string").alias("clip_id"), F.col("turn").alias("scene_no"), (F.length("text") % 90).cast("long").alias("duration")), 30, 1, 1000)


@query("first_at_or_after", f"""{P}, t AS (SELECT track_id, CAST(min(dts) + (max(dts) - min(dts)) * (track_id % 5) // 3 AS BIGINT) AS target FROM p GROUP BY track_id)
    SELECT CAST(p.track_id AS VARCHAR) AS clip_id, target, coalesce(arg_min(event_id, dts) FILTER (WHERE dts >= target), arg_max(event_id, dts)) AS frame_no FROM p JOIN t USING (track_id) GROUP BY ALL""")
def first_at_or_after(spark, sf_dir):
    p = packets(spark, sf_dir).select(F.col("track_id").cast("string").alias("clip_id"), "track_id", F.col("event_id").alias("frame_no"), F.col("dts").alias("ts"))
    t = p.groupBy("clip_id", "track_id").agg(F.expr("min(ts) + (max(ts) - min(ts)) * (track_id % 5) div 3").alias("target")).drop("track_id")
    return pk.first_at_or_after(p.drop("track_id"), t)


@query("config_sessions", f"""{P}, n AS (SELECT *, CASE WHEN config_version <> lag(config_version) OVER w THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY track_id ORDER BY dts, event_id)),
    s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY track_id ORDER BY dts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n)
    SELECT source_id, track_id, session, min(dts) AS start_dts, count(*) AS n_packets FROM s GROUP BY ALL""")
def config_sessions(spark, sf_dir):
    return pk.config_sessions(packets(spark, sf_dir), ("dts", "event_id"))


@query("frame_to_packet", """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS source_id, turn AS frame_index, CAST(length(text) * 441 AS BIGINT) AS n FROM conversations),
    b AS (SELECT source_id, frame_index, CAST(coalesce(sum(n) OVER (PARTITION BY source_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) * 1000 AS p FROM c)
    SELECT source_id, frame_index, CAST(p // 44100 + CASE WHEN p % 44100 * 2 > 44100 OR (p % 44100 * 2 = 44100 AND (p // 44100) % 2 <> 0) THEN 1 ELSE 0 END AS BIGINT) AS pts FROM b""")
def frame_to_packet(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").alias("frame_index"), (F.length("text") * 441).cast("long").alias("sample_count"))
    return pk.from_frames(rows, 44100, 1000).select("source_id", "frame_index", "pts")


@query("silence", "SELECT CAST(n_nationkey AS VARCHAR) AS clip_id, CAST(unnest(range(n_nationkey * 10)) AS BIGINT) AS frame, CAST(0 AS INTEGER) AS sample FROM nation")
def silence(spark, sf_dir):
    return align.silence(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("clip_id"), (F.col("n_nationkey") * 10).alias("n_frames")))


@query("max_absolute", f"WITH {samples_sql()} SELECT clip_id, max(abs(CAST(sample AS BIGINT))) AS peak, count(*) FILTER (WHERE abs(sample) > 32767) AS n_clipped FROM s GROUP BY clip_id")
def max_absolute(spark, sf_dir):
    return analysis.max_absolute(samples(spark, sf_dir), 16)


# A plane of 40 columns from part, a smaller image from supplier.
_PLANE = "pl AS (SELECT CAST(p_partkey % 40 AS INTEGER) AS x, CAST(p_partkey // 40 AS INTEGER) AS y, CAST(p_size * 5 AS INTEGER) AS value FROM part)"
_IMAGE = "im AS (SELECT CAST(s_suppkey % 10 AS INTEGER) + 35 AS x, CAST(s_suppkey // 10 AS INTEGER) + 3 AS y, CAST(s_suppkey % 256 AS INTEGER) AS v, CAST(s_suppkey * 11 % 256 AS INTEGER) AS a FROM supplier)"


def _plane(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select((k % 40).cast("int").alias("x"), F.floor(k / 40).cast("int").alias("y"), (F.col("p_size") * 5).cast("int").alias("value"))


@query("overlay_pixels", f"WITH {_PLANE}, {_IMAGE} SELECT pl.x, pl.y, CAST(CASE WHEN v IS NULL THEN value ELSE (value * (255 - a) + v * a + 127) // 255 END AS INTEGER) AS value FROM pl LEFT JOIN im ON pl.x = im.x AND pl.y = im.y")
def overlay_pixels(spark, sf_dir):
    k = F.col("s_suppkey")
    image = read(spark, sf_dir, "supplier").select((k % 10).cast("int").alias("x"), F.floor(k / 10).cast("int").alias("y"), (F.col("s_suppkey") % 256).cast("int").alias("value"), (F.col("s_suppkey") * 11 % 256).cast("int").alias("alpha"))
    return align.overlay(_plane(spark, sf_dir), image, 35, 3).select("x", "y", "value")


@query("crop_pixels", f"WITH {_PLANE} SELECT x - 4 AS x, y - 1 AS y, value FROM pl WHERE x BETWEEN 4 AND 13 AND y BETWEEN 1 AND 3")
def crop_pixels(spark, sf_dir):
    return align.crop(_plane(spark, sf_dir), 4, 1, 10, 3)


@query("rotate_pixels", f"WITH {_PLANE} SELECT CAST(49 - y AS INTEGER) AS x, x AS y, value FROM pl")
def rotate_pixels(spark, sf_dir):
    return align.rotate(_plane(spark, sf_dir), 40, 50, 90).select("x", "y", "value")


@query("box_blur_rows", f"""WITH {_PLANE} SELECT x, y, CAST((sum(value) OVER w + (2 - least(x, 2)) * first_value(value) OVER r + (2 - least(39 - x, 2)) * last_value(value) OVER r) * 2 // 10 AS INTEGER) AS value
    FROM pl WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), r AS (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def box_blur_rows(spark, sf_dir):
    """One pass of a box of radius 2 along the rows, edges repeated, rounded down."""
    by = Window.partitionBy("y").orderBy("x")
    row = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left, right = (2 - F.least(F.col("x"), F.lit(2))) * F.first("value").over(row), (2 - F.least(39 - F.col("x"), F.lit(2))) * F.last("value").over(row)
    total = F.sum("value").over(by.rowsBetween(-2, 2)) + left + right
    return _plane(spark, sf_dir).select("x", "y", F.floor(total * 2 / 10).cast("int").alias("value"))
