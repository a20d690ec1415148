"""Adapters from the test tables to the signal schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def samples(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """Mono clips from events: one clip a key, frames in (ts, event_id) order, values scaled past 16 bits."""
    w = Window.partitionBy("clip_id").orderBy("ts", "event_id")
    return (
        read(spark, sf_dir, "events")
        .select(F.col(key).cast("string").alias("clip_id"), "ts", "event_id", F.rint((F.col("value") - 50) * 100).cast("int").alias("sample"))
        .select("clip_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), "sample")
    )


# The same adapter in DuckDB SQL, as the CTE "s".
def samples_sql(key: str = "user_id") -> str:
    return f"""s AS (SELECT CAST({key} AS VARCHAR) AS clip_id,
      CAST(row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
      CAST(round_even((value - 50) * 100, 0) AS INTEGER) AS sample FROM events)"""


def stereo(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """Two channels from events: the sample and three quarters of it."""
    x = F.col("sample")
    both = F.array(F.struct(F.lit(0).alias("channel"), x.alias("sample")), F.struct(F.lit(1).alias("channel"), F.expr("cast((sample * 3) div 4 as int)").alias("sample")))
    return samples(spark, sf_dir, key).select("clip_id", "frame", F.inline(both))


def stereo_sql(key: str = "user_id") -> str:
    return samples_sql(key) + """, t AS (SELECT clip_id, frame, c.channel,
      CASE WHEN c.channel = 0 THEN sample ELSE CAST(trunc(sample * 3 / 4.0) AS INTEGER) END AS sample FROM s, (VALUES (0), (1)) c(channel))"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track a user from events: microsecond times, key packets at signups, versions that grow with errors."""
    w = Window.partitionBy("track_id").orderBy("dts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    us = micros("ts")
    return (
        read(spark, sf_dir, "events")
        .select(
            F.lit("all").alias("source_id"), F.col("user_id").alias("track_id"), us.alias("pts"), us.alias("dts"), "event_id", (F.col("event_type") == "signup").alias("is_keyframe"),
            (F.col("event_type") == "error").cast("int").alias("_e"),
        )
        .withColumn("config_version", F.sum("_e").over(w))
        .drop("_e")
    )


PACKETS_SQL = """p AS (SELECT 'all' AS source_id, user_id AS track_id, epoch_us(ts) AS pts, epoch_us(ts) AS dts, event_id, event_type = 'signup' AS is_keyframe,
      CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS config_version FROM events)"""
