"""Operators on single samples, pixels and values: column expressions only.

Columns are the long form (clip_id, frame, channel, sample) unless said
otherwise; every function returns a column, so that Catalyst fuses a chain of
them into one projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.operators.format import native_range


def clamp(x: Column, bits: int) -> Column:
    lo, hi = native_range(bits)
    return F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo)))


def truncated(x: Column, bits: int) -> Column:
    """Clamped to the range, then cut toward zero."""
    return clamp(x, bits).cast("int")


def rounded(x: Column, bits: int) -> Column:
    """Rounded half to even, then clamped."""
    return clamp(F.rint(x), bits).cast("int")


def gain(x: Column, g: float, bits: int) -> Column:
    if not math.isfinite(g) or g < 0:
        raise ValueError("gain must be finite and not negative")
    if g == 1:
        return x
    return F.lit(0) if g == 0 else truncated(x.cast("double") * g, bits)


def pan_gains(pan: float, law: str = "linear") -> tuple[float, float]:
    """Gains of the left and right channel at a position from -1 to 1."""
    if not -1 <= pan <= 1:
        raise ValueError("pan must lie between -1 and 1")
    if law == "linear":
        return min(1.0, 1 - pan), min(1.0, 1 + pan)
    if law == "equal_power":
        angle = (pan + 1) * math.pi / 4
        return math.cos(angle), math.sin(angle)
    raise ValueError(f"unknown law {law}")


def pan(x: Column, channel: Column, position: float, bits: int, law: str = "linear") -> Column:
    left, right = pan_gains(position, law)
    return truncated(x.cast("double") * F.when(channel == 0, left).otherwise(right), bits)


def rescale_bits(x: Column, source: int, target: int) -> Column:
    """Widen by shifting; narrow by rounding half away from zero, then clamp."""
    native_range(source)
    lo, hi = native_range(target)
    if target == source:
        return x
    if target > source:
        return (x.cast("long") * (1 << (target - source))).cast("int")
    d = 1 << (source - target)
    wide = x.cast("long")
    size = F.floor((F.abs(wide) + d // 2) / d)
    return F.greatest(F.least(F.when(wide < 0, -size).otherwise(size), F.lit(hi)), F.lit(lo)).cast("int")


def to_float(x: Column, bits: int) -> Column:
    return (x.cast("double") / native_range(bits)[1]).cast("float")


def _unit(x: Column) -> Column:
    return F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0))


def float_to_int32(x: Column) -> Column:
    """NaN is 0; clamped to one, scaled and cut toward zero."""
    return F.when(F.isnan(x), 0).otherwise((_unit(x) * 2147483647.0).cast("int"))


def float_to_int16(x: Column) -> Column:
    """NaN is 0; scaled, rounded half to even and clamped."""
    return F.when(F.isnan(x), 0).otherwise(rounded(x.cast("double") * 32767.0, 16))


def fade_gain(frame: Column, total: Column, fade_in: int, fade_out: int, curve: str = "linear") -> Column:
    """The smaller of the fade-in and the fade-out gain at a frame; 1 outside both."""
    if fade_in < 0 or fade_out < 0:
        raise ValueError("fades must not be negative")
    if curve not in ("linear", "equal_power"):
        raise ValueError(f"unknown curve {curve}")

    def shape(t: Column) -> Column:
        t = F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0))
        return t if curve == "linear" else F.sin(t * (math.pi / 2))

    rise = F.when(frame < fade_in, shape(frame / fade_in)).otherwise(1.0) if fade_in else F.lit(1.0)
    fall = F.when(frame >= total - fade_out, shape((total - 1 - frame) / fade_out)).otherwise(1.0) if fade_out else F.lit(1.0)
    return F.least(rise, fall)


def fade(x: Column, frame: Column, total: Column, fade_in: int, fade_out: int, curve: str = "linear") -> Column:
    return F.rint(x.cast("double") * fade_gain(frame, total, fade_in, fade_out, curve)).cast("int")


def remix_matrix(source: int, target: int) -> list[tuple[int, int, float]]:
    """(input, output, weight) of a channel conversion."""
    if source < 1 or target < 1:
        raise ValueError("channel counts must be positive")
    if target >= source:
        return [(o % source, o, 1.0) for o in range(target)]
    out = []
    for o in range(target):
        lo, hi = round(source * o / target), round(source * (o + 1) / target)
        out += [(i, o, 1.0 / (hi - lo)) for i in range(lo, hi)]
    return out


def remix(samples: DataFrame, source: int, target: int) -> DataFrame:
    """Every output channel as the rounded weighted sum of its input channels; not clamped."""
    spark: SparkSession = samples.sparkSession
    matrix = spark.createDataFrame(remix_matrix(source, target), "channel int, to int, weight float")
    joined = samples.join(F.broadcast(matrix), "channel")
    return joined.groupBy("clip_id", "frame", F.col("to").alias("channel")).agg(
        F.rint(F.sum(F.col("sample").cast("double") * F.col("weight").cast("double"))).cast("int").alias("sample")
    )


# G.711: closed forms on the code byte.
def alaw_expand(code: Column) -> Column:
    a = code.cast("int").bitwiseXOR(F.lit(0x55))
    q, s = a.bitwiseAND(F.lit(15)), F.shiftright(a.bitwiseAND(F.lit(0x70)), 4)
    size = F.when(s == 0, (2 * q + 1) * 8).otherwise((2 * q + 33) * F.pow(F.lit(2), s + 2).cast("int"))
    return F.when(a.bitwiseAND(F.lit(0x80)) != 0, size).otherwise(-size).cast("int")


def mulaw_expand(code: Column) -> Column:
    u = F.lit(255) - code.cast("int")
    size = (u.bitwiseAND(F.lit(15)) * 8 + 0x84) * F.pow(F.lit(2), F.shiftright(u.bitwiseAND(F.lit(0x70)), 4)).cast("int")
    return F.when(u.bitwiseAND(F.lit(0x80)) != 0, 0x84 - size).otherwise(size - 0x84).cast("int")


def rgb_to_ycbcr(r: Column, g: Column, b: Column, matrix: str = "bt601", full: bool = False) -> list[Column]:
    """Y, Cb and Cr of 8-bit RGB, rounded half away from zero and clamped."""
    kr, kb = LUMA[matrix]
    r, g, b = (c.cast("double") / 255.0 for c in (r, g, b))
    y = kr * r + (1 - kr - kb) * g + kb * b
    cb, cr = (b - y) / (2 * (1 - kb)), (r - y) / (2 * (1 - kr))
    parts = (255.0 * y, 128 + 255.0 * cb, 128 + 255.0 * cr) if full else (16 + 219.0 * y, 128 + 224.0 * cb, 128 + 224.0 * cr)
    return [F.greatest(F.least(F.round(p, 0), F.lit(255.0)), F.lit(0.0)).cast("int") for p in parts]


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, matrix: str = "bt601", full: bool = False) -> list[Column]:
    kr, kb = LUMA[matrix]
    luma = y.cast("double") / 255.0 if full else (y.cast("double") - 16) / 219.0
    scale = 255.0 if full else 224.0
    b = luma + (cb.cast("double") - 128) / scale * (2 * (1 - kb))
    r = luma + (cr.cast("double") - 128) / scale * (2 * (1 - kr))
    g = (luma - kr * r - kb * b) / (1 - kr - kb)
    return [F.greatest(F.least(F.round(c * 255.0, 0), F.lit(255.0)), F.lit(0.0)).cast("int") for c in (r, g, b)]


# Weights of red and blue in luma.
LUMA = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722)}


def conversion_matrix(source: str, target: str) -> list[list[float]]:
    """The 3 by 3 matrix from luma, blue and red difference (unscaled) of one standard to another's."""
    (kr, kb), (to_r, to_b) = LUMA[source], LUMA[target]
    columns = []
    for luma, cb, cr in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)):
        r, b = luma + 2 * (1 - kr) * cr, luma + 2 * (1 - kb) * cb
        g = (luma - kr * r - kb * b) / (1 - kr - kb)
        y = to_r * r + (1 - to_r - to_b) * g + to_b * b
        columns.append((y, (b - y) / (2 * (1 - to_b)), (r - y) / (2 * (1 - to_r))))
    return [list(row) for row in zip(*columns, strict=True)]


def convert_matrix(y: Column, cb: Column, cr: Column, source: str, target: str) -> list[Column]:
    """Unscaled luma and colour differences in another standard's matrix."""
    return [y * row[0] + cb * row[1] + cr * row[2] for row in conversion_matrix(source, target)]


def plain_subtitle(text: Column) -> Column:
    """Subtitle text without override tags, its escapes resolved."""
    out = F.regexp_replace(text, r"\{[^}]*\}", "")
    out = F.replace(F.replace(out, F.lit("\\N"), F.lit("\n")), F.lit("\\h"), F.lit(" "))
    return F.replace(F.replace(out, F.lit("\\n"), F.lit(" ")), F.lit("\r\n"), F.lit("\n"))


def is_active(t: Column, start: Column, end: Column) -> Column:
    """start <= t < end, a null border being open."""
    return (start.isNull() | (t >= start)) & (end.isNull() | (t < end))


def channel_layout(channels: Column) -> Column:
    # Names by channel count.
    names = {1: "mono", 2: "stereo", 3: "2.1", 4: "quad", 6: "5.1", 8: "7.1"}
    out = None
    for n, name in names.items():
        out = F.when(channels == n, name) if out is None else out.when(channels == n, name)
    return out.otherwise(F.concat(channels.cast("string"), F.lit(" channels")))


def mpeg_audio_header(h: Column) -> dict[str, Column]:
    """Fields of a 32-bit MPEG audio frame header; valid is false for reserved values."""
    bits = lambda at, n: F.shiftrightunsigned(h.cast("long"), at).bitwiseAND(F.lit((1 << n) - 1))
    version, layer, rate_at = bits(19, 2), bits(17, 2), bits(10, 2)
    base = F.when(rate_at == 0, 44100).when(rate_at == 1, 48000).otherwise(32000)
    rate = F.when(version == 3, base).when(version == 2, base / 2).otherwise(base / 4).cast("int")
    valid = (bits(21, 11) == 0x7FF) & (version != 1) & (layer != 0) & (bits(12, 4) != 15) & (rate_at != 3)
    return {
        "valid": valid,
        "version": F.when(version == 3, "1").when(version == 2, "2").otherwise("2.5"),
        "layer": (F.lit(4) - layer).cast("int"),
        "bitrate_index": bits(12, 4).cast("int"),
        "sample_rate": F.when(rate_at != 3, rate),
        "padding": bits(9, 1).cast("int"),
        "channels": F.when(bits(6, 2) == 3, 1).otherwise(2),
    }


def audio_specific_config(word: Column) -> dict[str, Column]:
    """Object type, sample rate and channels of the first two bytes (as a number) of an AAC configuration."""
    # Rates by index.
    rates = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
    n = word.cast("int")
    index = F.shiftright(n, 7).bitwiseAND(F.lit(15))
    return {
        "object_type": F.shiftright(n, 11).bitwiseAND(F.lit(31)),
        "sample_rate": F.get(F.array(*[F.lit(r) for r in rates]), index),
        "channels": F.shiftright(n, 3).bitwiseAND(F.lit(15)),
    }
