"""Scalar operators as temporary SQL functions, inlined into queries by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "native_min(bits INT) RETURNS BIGINT": "-shiftleft(1L, bits - 1)",
    "native_max(bits INT) RETURNS BIGINT": "shiftleft(1L, bits - 1) - 1",
    "pcm_gain(x INT, g DOUBLE, bits INT) RETURNS INT": "CASE WHEN g = 1 THEN x WHEN g = 0 THEN 0 ELSE CAST(greatest(least(x * g, CAST(shiftleft(1L, bits - 1) - 1 AS DOUBLE)), CAST(-shiftleft(1L, bits - 1) AS DOUBLE)) AS INT) END",
    "pcm_to_float(x INT, bits INT) RETURNS FLOAT": "CAST(x / CAST(shiftleft(1L, bits - 1) - 1 AS DOUBLE) AS FLOAT)",
    "alaw_expand(c INT) RETURNS INT": "CASE WHEN ((c ^ 85) & 128) <> 0 THEN 1 ELSE -1 END * CASE WHEN ((c ^ 85) & 112) = 0 THEN shiftleft(2 * ((c ^ 85) & 15) + 1, 3) ELSE shiftleft(2 * ((c ^ 85) & 15) + 33, shiftright((c ^ 85) & 112, 4) + 2) END",
    "mulaw_expand(c INT) RETURNS INT": "CASE WHEN ((255 - c) & 128) <> 0 THEN -1 ELSE 1 END * (shiftleft(((255 - c) & 15) * 8 + 132, shiftright((255 - c) & 112, 4)) - 132)",
    "composition_offset(pts BIGINT, dts BIGINT) RETURNS BIGINT": "pts - dts",
    "frame_slot(t BIGINT, num BIGINT, den BIGINT, ticks BIGINT) RETURNS BIGINT": "CAST(floor((CAST(t AS DECIMAL(19,0)) * num * 2 + ticks * den) / (2 * ticks * den)) AS BIGINT)",
    "pixel_blend(a INT, b INT, w INT) RETURNS INT": "shiftright(a * (256 - w) + b * w + 128, 8)",
    "pixel_composite(below INT, above INT, alpha INT) RETURNS INT": "(below * (255 - alpha) + above * alpha + 127) div 255",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in a session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
