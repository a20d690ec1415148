import numpy as np
from pyspark.sql import functions as F

from wavelattice.operators import packets as pk
from wavelattice.streaming import stateful


def _stream(spark, df, folder, parts):
    """The rows of ``df`` as a stream of files, one for each range of event_id."""
    n = df.count()
    for k in range(parts):
        df.where((F.col("event_id") >= n * k // parts) & (F.col("event_id") < n * (k + 1) // parts)).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))


def _captures(spark):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.integers(1, 400_000, 300))
    return spark.createDataFrame([(f"s{i % 3}", int(t[i]), i, int(rng.integers(0, 3000))) for i in range(300)], "source_id string, ts_us long, event_id long, n_frames long")


def test_gap_filling_in_micro_batches_equals_the_batch(spark, tmp_path):
    rows = _captures(spark)
    out = stateful.fill_gaps(_stream(spark, rows, tmp_path / "in", 3), 8000)
    q = out.writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: (r.fill_frames, r.start_frame) for r in spark.table("gaps").collect() if not r.late}
    want = {r.event_id: (r.fill_frames, r.start_frame) for r in pk.fill_gaps(rows, 8000, 0.1, ("ts_us", "event_id")).collect()}
    assert got == want


def test_segments_in_micro_batches(spark, tmp_path):
    rows = _captures(spark).select("source_id", F.col("ts_us").alias("pts"), "event_id", (F.col("event_id") % 5 == 0).alias("is_keyframe"))
    out = stateful.segments(_stream(spark, rows, tmp_path / "in", 3), 5.0, 1_000_000)
    q = out.writeStream.format("memory").queryName("segs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.source_id, r.sequence, r.start_pts, r.duration_s) for r in spark.table("segs").collect())
    batch = rows.withColumn("track_id", F.lit(0)).withColumn("dts", F.col("pts"))
    all_ = pk.segments(batch, 0, 5.0, 1_000_000, ("dts", "event_id"), 1).collect()
    last = {}
    for r in all_:
        last[r.source_id] = max(last.get(r.source_id, 0), r.sequence)
    assert got == sorted((r.source_id, r.sequence, r.start_pts, r.duration_s) for r in all_ if r.sequence < last[r.source_id])


def test_an_idle_source_ends_with_its_last_segment(spark, tmp_path):
    import time

    rows = _captures(spark).select("source_id", F.col("ts_us").alias("pts"), "event_id", (F.col("event_id") % 5 == 0).alias("is_keyframe"))
    out = stateful.segments(_stream(spark, rows, tmp_path / "in", 1), 5.0, 1_000_000, idle_ms=500)
    q = out.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    batch = rows.withColumn("track_id", F.lit(0)).withColumn("dts", F.col("pts"))
    want = {(r.source_id, r.sequence, r.start_pts) for r in pk.segments(batch, 0, 5.0, 1_000_000, ("dts", "event_id"), 1).collect()}
    got, until = set(), time.time() + 90
    while got != want and time.time() < until:
        time.sleep(1)
        got = {(r.source_id, r.sequence, r.start_pts) for r in spark.table("idle").collect()}
    q.stop()
    assert got == want


def test_level_windows_drop_late_rows(spark, tmp_path):
    rows = spark.createDataFrame([("s", f"2024-01-01 {h:02d}:{m:02d}:00", v) for h, m, v in ((0, 1, 5), (0, 9, -7), (0, 11, 3), (5, 0, 1), (9, 0, 1))], "source_id string, at string, sample int")
    rows = rows.withColumn("ts", F.to_timestamp("at")).withColumn("event_id", F.monotonically_increasing_id()).drop("at")
    folder = tmp_path / "in"
    rows.coalesce(1).write.mode("append").parquet(str(folder))
    late = spark.createDataFrame([("s", "2024-01-01 00:02:00", 99), ("s", "2024-01-01 12:00:00", 2)], "source_id string, at string, sample int")
    stream = stateful.level_windows(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    for _ in range(2):
        sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
        q = sink.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        late.withColumn("ts", F.to_timestamp("at")).withColumn("event_id", F.lit(100).cast("long")).drop("at").select(*rows.columns).coalesce(1).write.mode("append").parquet(str(folder))
    got = {(str(r.start), r.peak, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got >= {("2024-01-01 00:00:00", 7, 2), ("2024-01-01 00:10:00", 3, 1)} and all(peak != 99 for _, peak, _ in got)


def test_a_change_counts_only_against_the_same_track(spark):
    rows = [("s", t, k * 500_000, k, k % 2 == 0 and t == 0, 5 if t == 0 else 9 + (k >= 9)) for k in range(16) for t in (0, 1)]
    packets = spark.createDataFrame(rows, "source_id string, track_id int, pts long, event_id long, is_keyframe boolean, version int").withColumn("dts", F.col("pts"))
    cut = lambda df: [(r.start_pts, r.duration_s, r.discontinuity) for r in pk.segments(df, 0, 3.0, 1_000_000, ("dts", "event_id", "track_id"), 1, breaks="version").orderBy("sequence").collect()]
    assert cut(packets.where("event_id < 9")) == [(0, 3.0, False), (3_000_000, 1.5, False)]
    # The audio's change at 4.5 s ends the segment; the next key picture starts a discontinuous one.
    assert cut(packets) == [(0, 3.0, False), (3_000_000, 2.0, False), (5_000_000, 3.0, True)]
