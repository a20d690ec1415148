"""Operators on timestamped packets, frames and segments.

packets: source_id, track_id, pts, dts, is_keyframe and more. Order inside a
track is by dts with a unique tie-break. Rescaling is exact in decimals.
Segmenting and gap filling are recurrences and run source by source.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rescale(value: Column, source: int | Column, target: int | Column) -> Column:
    """value * target / source, rounded half to even; an overflow of 64 bits is an error."""
    s, t = (F.lit(x) if isinstance(x, int) else x for x in (source, target))
    p = value.cast("decimal(19,0)") * t.cast("decimal(10,0)")
    s = s.cast("decimal(10,0)")
    sign = F.when(p < 0, F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    size = F.abs(p)
    rest = size % s
    whole = ((size - rest) / s).cast("decimal(29,0)")
    up = (rest * 2 > s) | ((rest * 2 == s) & (whole % 2 != 0))
    return ((whole + F.when(up, 1).otherwise(0)) * sign).cast("long")


def frame_slot(t: Column, rate_num: int, rate_den: int, ticks_per_s: int = 10_000_000) -> Column:
    """Nearest frame index of a time at a rational rate, half away from zero."""
    n, d = t.cast("decimal(19,0)") * rate_num, ticks_per_s * rate_den
    return F.floor((n * 2 + d) / (2 * d)).cast("long")


def slot_time(slot: Column, rate_num: int, rate_den: int, ticks_per_s: int = 10_000_000) -> Column:
    n = slot.cast("decimal(19,0)") * (ticks_per_s * rate_den)
    return F.floor((n * 2 + rate_num) / (2 * rate_num)).cast("long")


def _track(*order: str) -> Window:
    return Window.partitionBy("source_id", "track_id").orderBy(*order)


def durations(packets: DataFrame, default: int, order: tuple[str, ...] = ("dts",)) -> DataFrame:
    """Each packet's time to the next of its track; the last repeats the one before, alone the default."""
    w = _track(*order)
    step = F.lead("dts").over(w) - F.col("dts")
    back = F.col("dts") - F.lag("dts").over(w)
    return packets.withColumn("duration", F.coalesce(step, back, F.lit(default)))


def composition_offset(pts: Column, dts: Column) -> Column:
    return pts - dts


def interleaved(packets: DataFrame, tracks: DataFrame) -> DataFrame:
    """All tracks of a source in exact time order across timescales, ties by track order.

    Times are compared as dts * (product over the other scales), here as exact
    decimal nanoseconds over a common scale: dts * lcm / timescale.
    """
    w = Window.partitionBy("source_id").orderBy("_time", "track_no", "dts")
    scale = F.broadcast(tracks.select("track_id", "track_no", "timescale", "common"))
    out = packets.join(scale, "track_id").withColumn("_time", F.col("dts").cast("decimal(19,0)") * F.expr("common div timescale").cast("decimal(18,0)"))
    return out.withColumn("position", F.row_number().over(w) - 1).drop("_time", "common")


def unwrap32(packets: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Wrapping 32-bit times as a running sum of signed differences."""
    w = Window.partitionBy("source_id").orderBy(*order)
    raw = F.pmod(F.col(column), F.lit(1 << 32))
    d = F.pmod(raw - F.lag(raw).over(w) + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    return packets.withColumn("_d", F.coalesce(d, raw)).withColumn("time", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def decode_times(pts: list[int], depth: int = 16) -> list[int]:
    """reconstruct_dts of one track's presentation times in arrival order."""
    heap, out, shift = [], [], None
    for i, p in enumerate(pts):
        heapq.heappush(heap, p)
        if len(heap) > depth or i + 1 == len(pts):
            if shift is None:
                shift = max(0, max(a - b for a, b in zip(sorted(heap), pts, strict=False)))
            out.append(heapq.heappop(heap) - shift)
    while heap:
        out.append(heapq.heappop(heap) - shift)
    return out


def reconstruct_dts(frames: DataFrame, depth: int = 16) -> DataFrame:
    """Decode times from presentation times in arrival order, by a reorder buffer of ``depth``.

    The k-th packet to leave gets the k-th smallest of the buffered times,
    less the shift that keeps the first packets' decode times at or below
    their presentation times. Exact while reordering fits the buffer.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arrival")
        pdf["dts"] = decode_times(pdf["pts"].tolist(), depth)
        return pdf[["source_id", "arrival", "pts", "dts"]]

    return frames.groupBy("source_id").applyInPandas(run, "source_id string, arrival long, pts long, dts long")


def change_frame_rate(frames: DataFrame, rate_num: int, rate_den: int, ticks_per_s: int) -> DataFrame:
    """Frames on a regular grid: the last one in a slot wins and fills the slots up to the next."""
    w = Window.partitionBy("clip_id")
    out = frames.withColumn("_first", F.min("ts").over(w)).withColumn("slot", frame_slot(F.col("ts") - F.col("_first"), rate_num, rate_den, ticks_per_s))
    last = Window.partitionBy("clip_id", "slot").orderBy(F.desc("ts"), F.desc("frame_no"))
    out = out.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    n = F.lead("slot").over(Window.partitionBy("clip_id").orderBy("slot"))
    return out.withColumn("_next", F.coalesce(n, F.col("slot") + 1)).select("clip_id", F.explode(F.sequence("slot", F.col("_next") - 1)).alias("out_frame"), "frame_no")


def invalid_order(packets: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Packets with the rule they break, if any: dts not negative and increasing, pts not before dts, one version."""
    w = _track(*order)
    before = F.lag("dts").over(w)
    why = F.when(F.col("dts") < 0, "negative dts").when(F.col("pts") < F.col("dts"), "pts before dts").when(before >= F.col("dts"), "dts not increasing")
    return packets.withColumn("violation", why)


def split_at_keyframes(packets: DataFrame, cut_track: int, cuts: list[int]) -> DataFrame:
    """Part number and rebased times: each cut moves to the first key packet of its track at or after it."""
    keys = packets.where((F.col("track_id") == cut_track) & F.col("is_keyframe"))
    points = [keys.where(F.col("pts") >= c).groupBy("source_id").agg(F.min("pts").alias("at")) for c in cuts]
    at = points[0]
    for p in points[1:]:
        at = at.union(p)
    start = packets.where(F.col("track_id") == cut_track).groupBy("source_id").agg(F.min("pts").alias("_start"))
    at = at.join(start, "source_id").where(F.col("at") > F.greatest("_start", F.lit(0))).groupBy("source_id").agg(F.array_sort(F.collect_set("at")).alias("_cuts"))
    out = packets.join(at, "source_id", "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<bigint>")))
    passed = F.filter("_cuts", lambda c: c <= F.col("pts"))
    base = F.coalesce(F.array_max(passed), F.lit(0))
    return out.select(*packets.columns, F.size(passed).alias("part"), (F.col("pts") - base).alias("part_pts"), (F.col("dts") - base).alias("part_dts"))


def segments(packets: DataFrame, cut_track: int | None, target_s: float, timescale: int, order: tuple[str, ...], default_duration: int, breaks: str | None = None) -> DataFrame:
    """HLS segments of each source: cut at key packets of the cut track once the target is reached.

    Packets before the first cut point are dropped. With ``breaks`` a change in
    that column from one packet of a track to its next ends the segment, and
    the next key packet starts a discontinuous one. The rows of a source are read one after the other, nothing is kept of
    them but the segment in work.
    """
    columns = ["source_id", "track_id", "pts", "dts", "is_keyframe", *order, *([breaks] if breaks else [])]
    rows = packets.select(*dict.fromkeys(columns)).repartition("source_id").sortWithinPartitions("source_id", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, state, out = None, None, []

        def close(end: int, last: bool) -> None:
            out.append((source, state["n"], state["start"], (end - state["start"]) / timescale, state["broken"]))
            state["n"] += 1

        def finish() -> None:
            if state and state["start"] is not None and state["max"] is not None:
                close(state["max"] + (state["step"] or default_duration), True)

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.source_id != source:
                    finish()
                    source = r.source_id
                    state = {"n": 1, "start": None, "max": None, "step": None, "dts": None, "broken": False, "versions": {}}
                version = getattr(r, breaks) if breaks else None
                on_track = cut_track is None or r.track_id == cut_track
                point = on_track and (cut_track is None or r.is_keyframe)
                if breaks and state["versions"].get(r.track_id, version) != version and state["start"] is not None and state["max"] is not None:
                    close(state["max"] + (state["step"] or default_duration), False)
                    state |= {"start": None, "max": None, "step": None, "dts": None, "broken": True}
                state["versions"][r.track_id] = version
                if point:
                    if state["start"] is None:
                        state["start"] = r.pts
                    elif r.pts - state["start"] >= target_s * timescale:
                        close(r.pts, False)
                        state |= {"start": r.pts, "broken": False}
                if on_track and state["start"] is not None:
                    if state["dts"] is not None:
                        state["step"] = max(r.dts - state["dts"], 1)
                    state["dts"] = r.dts
                    state["max"] = r.pts if state["max"] is None else max(state["max"], r.pts)
            if out:
                yield pd.DataFrame(out, columns=["source_id", "sequence", "start_pts", "duration_s", "discontinuity"])
                out.clear()
        finish()
        if out:
            yield pd.DataFrame(out, columns=["source_id", "sequence", "start_pts", "duration_s", "discontinuity"])

    return rows.mapInPandas(run, "source_id string, sequence long, start_pts long, duration_s double, discontinuity boolean")


def frame_segments(frames: DataFrame, rate: int, target_s: float, order: tuple[str, ...]) -> DataFrame:
    """Segments of encoded frames: cut when the accumulated samples reach the target; the rest is the last one."""
    rows = frames.select("source_id", "sample_count", *order).repartition("source_id").sortWithinPartitions("source_id", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, n, k, total = None, 1, 0, 0
        for pdf in batches:
            out = []
            for s, c in zip(pdf["source_id"], pdf["sample_count"], strict=True):
                if s != source:
                    if total:
                        out.append((source, n, k, total / rate))
                    source, n, k, total = s, 1, 0, 0
                total += c
                k += 1
                if total / rate >= target_s:
                    out.append((source, n, k, total / rate))
                    n, k, total = n + 1, 0, 0
            if out:
                yield pd.DataFrame(out, columns=["source_id", "sequence", "n_frames", "duration_s"])
        if total:
            yield pd.DataFrame([(source, n, k, total / rate)], columns=["source_id", "sequence", "n_frames", "duration_s"])

    return rows.mapInPandas(run, "source_id string, sequence long, n_frames long, duration_s double")


def fill_gaps(captures: DataFrame, rate: int, threshold_s: float = 0.1, order: tuple[str, ...] = ("ts_us",)) -> DataFrame:
    """Silent frames to insert before each capture so that frames keep up with the capture clock.

    The gap is trunc(elapsed * rate) less the frames so far, inserted ones
    included; it is filled if it is longer than the threshold. A capture
    without a time is never preceded by a fill.
    """
    rows = captures.select("source_id", "ts_us", "n_frames", *[o for o in order if o != "ts_us"]).repartition("source_id").sortWithinPartitions("source_id", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, origin, so_far = None, None, 0
        for pdf in batches:
            fills, starts = [], []
            for s, t, n in zip(pdf["source_id"], pdf["ts_us"], pdf["n_frames"], strict=True):
                if s != source:
                    source, origin, so_far = s, None, 0
                fill = 0
                if not pd.isna(t):
                    if origin is None:
                        origin = int(t)
                    gap = (int(t) - origin) * rate // 1_000_000 - so_far
                    if gap > threshold_s * rate:
                        fill = gap
                fills.append(fill)
                starts.append(so_far + fill)
                so_far += fill + int(n)
            yield pdf.assign(fill_frames=fills, start_frame=starts)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, fill_frames long, start_frame long")


def retain_newest(segments_: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` segments of each source."""
    w = Window.partitionBy("source_id").orderBy(F.desc("sequence"))
    return segments_.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def media_playlist(segments_: DataFrame, target_s: float, ended: bool = True) -> DataFrame:
    """The media playlist text of each source (sequence, duration_s, uri, discontinuity)."""
    entry = F.concat(F.when(F.col("discontinuity"), "#EXT-X-DISCONTINUITY\n").otherwise(""), F.format_string("#EXTINF:%.6f,\n%s", "duration_s", "uri"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("sequence", entry.alias("e")))), lambda s: s.e)
    longest = F.ceil(F.greatest(F.max("duration_s"), F.lit(target_s)))
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:7\n#EXT-X-TARGETDURATION:"), longest.cast("string"), F.lit("\n#EXT-X-MEDIA-SEQUENCE:"), F.min("sequence").cast("string"), F.lit("\n"))
    text = F.concat(head, F.array_join(lines, "\n"), F.lit("\n#EXT-X-ENDLIST\n" if ended else "\n"))
    return segments_.groupBy("source_id").agg(text.alias("playlist"))


def codecs_string(tracks: DataFrame) -> DataFrame:
    """Distinct codec strings of each source, video first, joined by commas."""
    order = F.struct(F.when(F.col("kind") == "video", 0).otherwise(1).alias("k"), "track_id", "codec")
    listed = F.transform(F.array_sort(F.collect_list(order)), lambda t: t.codec)
    return tracks.groupBy("source_id").agg(F.array_join(F.array_distinct(listed), ",").alias("codecs"))


def sample_times(runs: DataFrame) -> DataFrame:
    """Decode time of every sample from run-length rows (track_id, entry, n_samples, delta)."""
    w = Window.partitionBy("track_id").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)
    based = runs.withColumn("_s", F.coalesce(F.sum("n_samples").over(w), F.lit(0))).withColumn("_t", F.coalesce(F.sum(F.col("n_samples") * F.col("delta")).over(w), F.lit(0)))
    out = based.where("n_samples > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_samples") - 1)))
    return out.select("track_id", (F.col("_s") + F.col("_k")).alias("sample_no"), (F.col("_t") + F.col("_k") * F.col("delta")).alias("dts"), F.col("delta").alias("duration"))


def join_offsets(files: DataFrame) -> DataFrame:
    """Start of each file of a joined stream: the ends (file_no, length) of those before it."""
    w = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("length").over(w), F.lit(0)))


def presentation_end(packets: DataFrame) -> DataFrame:
    return packets.groupBy("source_id", "track_id").agg(F.max(F.col("pts") + F.col("duration")).alias("presentation_end"), F.count("*").alias("n_packets"))


def master_playlist(renditions: DataFrame) -> DataFrame:
    """The master playlist text of each source (order_no, bandwidth, codecs, uri)."""
    entry = F.format_string('#EXT-X-STREAM-INF:BANDWIDTH=%d,CODECS="%s"\n%s', "bandwidth", "codecs", "uri")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("order_no", entry.alias("e")))), lambda r: r.e)
    return renditions.groupBy("source_id").agg(F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:7\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("playlist"))


def chunk_layout(packets: DataFrame, ticks: int, order: tuple[str, ...]) -> DataFrame:
    """Chunks of each track, of less than ``ticks`` from their first packet, in the order of their starts.

    A chunk's start depends on where the one before ended, so tracks are read in order.
    """
    rows = packets.select("source_id", "track_id", "dts", *[o for o in order if o != "dts"]).repartition("source_id", "track_id").sortWithinPartitions("source_id", "track_id", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, n = None, 0, 0
        for pdf in batches:
            out = []
            for source, track, dts in zip(pdf["source_id"], pdf["track_id"], pdf["dts"], strict=True):
                if key != (source, track) or dts - first >= ticks:
                    if key is not None:
                        out.append((*key, first, n))
                    key, first, n = (source, track), dts, 0
                n += 1
            if out:
                yield pd.DataFrame(out, columns=["source_id", "track_id", "start", "n_samples"])
        if key is not None:
            yield pd.DataFrame([(*key, first, n)], columns=["source_id", "track_id", "start", "n_samples"])

    kind = packets.schema["track_id"].dataType.simpleString()
    chunks = rows.mapInPandas(run, f"source_id string, track_id {kind}, start long, n_samples long")
    w = Window.partitionBy("source_id").orderBy("start", "track_id")
    return chunks.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def transport_order(packets: DataFrame, segment_ticks: int, arrival: str) -> DataFrame:
    """Place of each packet in its segment: by decode time, ties by arrival."""
    segment = F.floor(F.col("dts") / segment_ticks)
    w = Window.partitionBy("source_id", segment).orderBy("dts", arrival)
    return packets.withColumn("segment", segment.cast("long")).withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def timeline(scenes: DataFrame, rate_num: int, rate_den: int, ticks_per_s: int) -> DataFrame:
    """First frame and end frame of each scene (scene_no, duration ticks): rounded running ends, a frame each at least."""
    w = Window.partitionBy("clip_id").orderBy("scene_no")
    ends = scenes.withColumn("_end", frame_slot(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, 0)), rate_num, rate_den, ticks_per_s))
    # max(prev + 1, end) over all scenes is a running maximum of end - scene index.
    k = F.row_number().over(w).cast("long")
    ends = ends.withColumn("_k", k).withColumn("end_frame", F.greatest(F.max(F.col("_end") - F.col("_k")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.col("_k"))
    return ends.select("clip_id", "scene_no", F.coalesce(F.lag("end_frame").over(w), F.lit(0).cast("long")).alias("first_frame"), "end_frame")


def first_at_or_after(frames: DataFrame, targets: DataFrame) -> DataFrame:
    """For each clip's target time the first frame at or after it, else its last frame."""
    both = frames.join(targets, "clip_id")
    after = F.min_by("frame_no", F.when(F.col("ts") >= F.col("target"), F.col("ts")))
    return both.groupBy("clip_id", "target").agg(F.coalesce(after, F.max_by("frame_no", "ts")).alias("frame_no"))


def config_sessions(packets: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Runs of one codec configuration in each track, with their first time and size."""
    w = _track(*order)
    new = (F.col("config_version") != F.coalesce(F.lag("config_version").over(w), F.col("config_version"))).cast("long")
    runs = packets.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("source_id", "track_id", "session").agg(F.min("dts").alias("start_dts"), F.count("*").alias("n_packets"))


def from_frames(frames: DataFrame, rate: int, timescale: int) -> DataFrame:
    """Packets of encoded audio frames: pts is the running sample count, rescaled."""
    w = Window.partitionBy("source_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("sample_count").over(w), F.lit(0))
    pts = rescale(before, rate, timescale)
    return frames.withColumn("pts", pts).withColumn("dts", F.col("pts")).withColumn("is_keyframe", F.lit(True))


def find_track(packets: DataFrame, tracks: DataFrame, key: str = "track_id") -> DataFrame:
    """Packets with the description of their track; a packet of an unknown track is left out."""
    return packets.join(tracks, key)


def file_fields(packets: DataFrame) -> DataFrame:
    """Packets, key packets and presentation end of each track."""
    return packets.groupBy("source_id", "track_id").agg(F.count("*").alias("n_packets"), F.count_if("is_keyframe").alias("n_keyframes"), F.max(F.col("pts") + F.col("duration")).alias("end"))


def join_files(packets: DataFrame, order: str) -> DataFrame:
    """Packets of several files (value of ``order`` in each source) as one: each file starts where the one before it ends.

    A file ends at the latest of its packets' pts + duration; the start is
    taken from all its tracks alike, so that they stay together.
    """
    sizes = packets.groupBy("source_id", order).agg(F.max(F.col("pts") + F.col("duration")).alias("length"))
    w = Window.partitionBy("source_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source_id", order, F.coalesce(F.sum("length").over(w), F.lit(0)).alias("start"))
    out = packets.join(starts, ["source_id", order])
    return out.withColumn("pts", F.col("pts") + F.col("start")).withColumn("dts", F.col("dts") + F.col("start")).drop("start")
