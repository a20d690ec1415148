"""Structured Streaming forms of gap filling and segmenting.

State is kept for each source and is of fixed size. Rows that come earlier
than their source's last one are not processed: they are returned with
``late`` set, so that a sink can put them aside. With the same rows in order
the results equal those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fill_gaps(captures: DataFrame, rate: int, threshold_s: float = 0.1) -> DataFrame:
    """fill_frames and start_frame for streamed captures (source_id, ts_us, event_id, n_frames)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        origin, so_far, last, last_id = state.get if state.exists else (-1, 0, -1, -1)
        rows = pd.concat(list(batches)).sort_values(["ts_us", "event_id"])
        fills, starts, late = [], [], []
        for t, i, n in zip(rows["ts_us"].tolist(), rows["event_id"].tolist(), rows["n_frames"].tolist(), strict=True):
            if (t, i) <= (last, last_id):
                fills.append(0)
                starts.append(-1)
                late.append(True)
                continue
            origin = t if origin < 0 else origin
            gap = (t - origin) * rate // 1_000_000 - so_far
            fill = gap if gap > threshold_s * rate else 0
            fills.append(fill)
            starts.append(so_far + fill)
            late.append(False)
            so_far += fill + n
            last, last_id = t, i
        state.update((origin, so_far, last, last_id))
        yield rows.assign(fill_frames=fills, start_frame=starts, late=late)[["source_id", "ts_us", "event_id", "n_frames", "fill_frames", "start_frame", "late"]]

    return captures.groupBy("source_id").applyInPandasWithState(
        run,
        "source_id string, ts_us long, event_id long, n_frames long, fill_frames long, start_frame long, late boolean",
        "origin long, so_far long, last long, last_id long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def segments(packets: DataFrame, target_s: float, timescale: int, idle_ms: int | None = None) -> DataFrame:
    """Closed segments of streamed packets (source_id, pts, event_id, is_keyframe); the one in work stays in state.

    A source without packets for ``idle_ms`` is taken to have ended: its last
    segment is closed at its last packet and its state is given up.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start, last, last_id, dropped = state.get if state.exists else (1, -1, -1, -1, 0)
        if state.hasTimedOut:
            state.remove()
            if start >= 0 and last > start:
                yield pd.DataFrame([(key[0], number, start, (last - start) / timescale)], columns=["source_id", "sequence", "start_pts", "duration_s"])
            return
        rows = pd.concat(list(batches)).sort_values(["pts", "event_id"])
        out = []
        for pts, i, is_key in zip(rows["pts"].tolist(), rows["event_id"].tolist(), rows["is_keyframe"].tolist(), strict=True):
            if (pts, i) <= (last, last_id):
                dropped += 1
                continue
            last, last_id = pts, i
            if start < 0:
                start = pts if is_key else start
                dropped += not is_key
            elif is_key and pts - start >= target_s * timescale:
                out.append((key[0], number, start, (pts - start) / timescale))
                number, start = number + 1, pts
        state.update((number, start, last, last_id, dropped))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["source_id", "sequence", "start_pts", "duration_s"])

    return packets.groupBy("source_id").applyInPandasWithState(
        run,
        "source_id string, sequence long, start_pts long, duration_s double",
        "number long, start long, last long, last_id long, dropped long",
        "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def level_windows(samples: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Peak and count of each source over event-time windows; late rows beyond ``delay`` are dropped."""
    return (
        samples.withWatermark("ts", delay)
        .groupBy("source_id", F.window("ts", width).alias("w"))
        .agg(F.max(F.abs(F.col("sample").cast("long"))).alias("peak"), F.count("*").alias("n"))
        .select("source_id", F.col("w.start").alias("start"), "peak", "n")
    )
