"""Operators that bring clips, frames and intervals together by position or time.

None of them pairs rows beyond equal positions: mixes are unions and sums,
as-of lookups are windows over a union, interval lookups use time buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.operators.pointwise import rounded


def cut(samples: DataFrame, start_s: int, end_s: int, rate: int) -> DataFrame:
    """The frames of [start, end) seconds, counted from 0; clips that end before are gone."""
    if start_s < 0 or end_s < start_s:
        raise ValueError("the range must not be negative")
    first, last = start_s * rate, end_s * rate
    return samples.where((F.col("frame") >= first) & (F.col("frame") < last)).withColumn("frame", F.col("frame") - first)


def silence(clips: DataFrame) -> DataFrame:
    """Silent samples of clips (clip_id, n_frames); clips without frames give none."""
    frames = F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)
    return clips.where("n_frames > 0").select("clip_id", F.explode(frames).alias("frame"), F.lit(0).alias("sample"))


def block_slices(samples: DataFrame, block: int, start: int, end: int) -> DataFrame:
    """The frames [start, end) by the block they lie in, with their place in the slice of that block."""
    part = samples.where((F.col("frame") >= start) & (F.col("frame") < end))
    number = F.floor(F.col("frame") / block)
    return part.withColumn("block", number.cast("long")).withColumn("place", (F.col("frame") - F.greatest(number * block, F.lit(start))).cast("long"))


def concat(clips: list[DataFrame], clip_id: str) -> DataFrame:
    """One clip of all, in order; each starts where the one before ends."""
    if len(clips) < 2:
        raise ValueError("two clips at least are needed")
    parts = reduce(DataFrame.unionByName, [c.withColumn("_part", F.lit(i)) for i, c in enumerate(clips)])
    return concat_parts(parts, "_part", F.lit(clip_id)).drop("_part")


def concat_parts(parts: DataFrame, order: str, clip_id: Column) -> DataFrame:
    """Rebase each part (value of ``order``) behind those before it; lengths are a small aggregate."""
    sizes = parts.groupBy(order).agg((F.max("frame") + 1).alias("_n"))
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.select(order, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return parts.join(at, order).withColumn("frame", F.col("frame") + F.col("_start")).withColumn("clip_id", clip_id).drop("_start")


def mix(inputs: list[tuple[DataFrame, float]], bits: int) -> DataFrame:
    """Positional sum of clips with gains; shorter ones count as silent; rounded and clamped once."""
    if len(inputs) < 2:
        raise ValueError("two inputs at least are needed")
    parts = [c.withColumn("_x", F.col("sample").cast("double") * g) for c, g in inputs]
    keys = [k for k in ("clip_id", "frame", "channel") if k in inputs[0][0].columns]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(rounded(F.sum("_x"), bits).alias("sample"))


def looped(clip: DataFrame, length: int, offset: int, loop: bool) -> DataFrame:
    """Each clip shifted by ``offset`` frames and, looped, repeated up to ``length`` frames."""
    if not loop:
        return clip.withColumn("frame", F.col("frame") + offset).where(F.col("frame") < length)
    sizes = clip.groupBy("clip_id").agg((F.max("frame") + 1).alias("_n"))
    rounds = F.sequence(F.lit(0), F.ceil((F.lit(length) - offset) / F.col("_n")).cast("long"))
    out = clip.join(sizes, "clip_id").withColumn("_k", F.explode(rounds))
    return out.withColumn("frame", F.col("frame") + offset + F.col("_k") * F.col("_n")).where(F.col("frame") < length).drop("_k", "_n")


def length_rule(ends: list[int | None], rule: str, fixed: int | None = None) -> int:
    """Frames of a mix whose inputs end at ``ends``; None never ends."""
    known = [e for e in ends if e is not None]
    if rule == "fixed":
        out = fixed
    elif rule == "first":
        out = ends[0]
    elif rule == "shortest":
        out = min(known, default=None)
    elif rule == "longest":
        out = max(known) if len(known) == len(ends) else None
    else:
        raise ValueError(f"unknown rule {rule}")
    if out is None:
        raise ValueError("a looped input never ends under this rule")
    return out


def mix_float(inputs: list[tuple[DataFrame, float, int, bool]], length: int) -> DataFrame:
    """Float clips with (gain, offset in frames, loop), summed up to ``length`` frames; not clipped."""
    parts = [looped(c, length, o, loop).withColumn("_x", F.col("sample").cast("double") * g) for c, g, o, loop in inputs]
    return reduce(DataFrame.unionByName, parts).groupBy("clip_id", "frame").agg(F.sum("_x").alias("sample"))


def sample_and_hold(times: DataFrame, frames: DataFrame, by: list[str], value: list[str]) -> DataFrame:
    """For each row of ``times`` (by, t) the latest row of ``frames`` (by, t, value) at or before it.

    A union ordered by time and the last value seen: one shuffle on ``by``, no pairs.
    """
    held = F.struct(*value)
    both = frames.select(*by, "t", F.lit(0).alias("_side"), held.alias("_v")).unionByName(
        times.select(*by, "t", F.lit(1).alias("_side"), F.lit(None).cast(frames.select(held.alias("v")).schema["v"].dataType).alias("_v"))
    )
    w = Window.partitionBy(*by).orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_h", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*by, "t", *[F.col(f"_h.{v}").alias(v) for v in value])


def active_intervals(points: DataFrame, intervals: DataFrame, bucket: int, keep: list[str]) -> DataFrame:
    """Points (t) with the intervals (start, end) that hold them: start <= t < end.

    Intervals are listed under each time bucket that they touch, so the join is
    on equal buckets whatever the two sizes.
    """
    last = F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / bucket)
    spread = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), last)))
    near = points.withColumn("_b", F.floor(F.col("t") / bucket)).join(spread, "_b")
    return near.where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).select(*points.columns, *keep)


def kerning(glyphs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Glyphs (line, place, glyph, advance) with the adjustment for the pair with their next one, and where they start."""
    w = Window.partitionBy("line").orderBy("place")
    follow = glyphs.withColumn("right", F.lead("glyph").over(w))
    kern = pairs.select(F.col("left").alias("glyph"), "right", F.col("adjust"))
    moved = follow.join(kern, ["glyph", "right"], "left").withColumn("adjust", F.coalesce("adjust", F.lit(0)))
    x = F.coalesce(F.sum(F.col("advance") + F.col("adjust")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return moved.select("line", "place", "glyph", "adjust", x.alias("x"))


def keyframe_seek(packets: DataFrame, targets: DataFrame) -> DataFrame:
    """For each track's target the last key packet at or before it, else the first packet."""
    both = packets.join(targets, "track_id")
    before = F.max(F.when(F.col("is_keyframe") & (F.col("pts") <= F.col("target")), F.col("pts")))
    return both.groupBy("track_id", "target").agg(F.coalesce(before, F.min("pts")).alias("start_pts"))


# Pixels: planes in long form (frame_no, x, y, value), joined on equal places.
def crossfade(a: Column, b: Column, weight: int) -> Column:
    """Eight-bit blend with ``weight`` 256ths of b."""
    return F.shiftright(a * (256 - weight) + b * weight + 128, 8)


def composite(below: Column, above: Column, alpha: Column) -> Column:
    return F.floor((below * (255 - alpha) + above * alpha + 127) / 255).cast("int")


def overlay(base: DataFrame, image: DataFrame, x: int, y: int) -> DataFrame:
    """``base`` with the pixels of ``image`` (x, y, value[, alpha]) placed at (x, y); what falls outside is cut."""
    moved = image.select((F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), F.col("value").alias("_v"), (F.col("alpha") if "alpha" in image.columns else F.lit(255)).alias("_a"))
    out = composite(F.col("value"), F.col("_v"), F.col("_a"))
    return base.join(moved, ["x", "y"], "left").withColumn("value", F.coalesce(out, F.col("value"))).drop("_v", "_a")


def crop(plane: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return plane.where(inside).withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def rotate(plane: DataFrame, width: int, height: int, degrees: int) -> DataFrame:
    """Clockwise by a multiple of 90 degrees."""
    x, y = F.col("x"), F.col("y")
    places = {0: (x, y), 90: (height - 1 - y, x), 180: (width - 1 - x, height - 1 - y), 270: (y, width - 1 - x)}
    if degrees not in places:
        raise ValueError("degrees must be 0, 90, 180 or 270")
    nx, ny = places[degrees]
    return plane.select(*[c for c in plane.columns if c not in ("x", "y")], nx.cast("int").alias("x"), ny.cast("int").alias("y"))
