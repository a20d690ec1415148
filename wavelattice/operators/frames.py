"""Video frames as rows with 8-bit planes (y, u, v binary, 4:2:0): numpy over Arrow batches.

Every operator handles a batch of frames at a time and keeps the frames'
order and times; frames do not depend on each other, so any partitioning does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wavelattice.operators.pointwise import conversion_matrix


def planes(row) -> list[np.ndarray]:
    w, h = int(row.width), int(row.height)
    sizes = [(h, w), ((h + 1) // 2, (w + 1) // 2), ((h + 1) // 2, (w + 1) // 2)]
    return [np.frombuffer(getattr(row, p), np.uint8).reshape(s) for p, s in zip("yuv", sizes, strict=True)]


def apply(frames: DataFrame, f: Callable[[list[np.ndarray], object], list[np.ndarray]]) -> DataFrame:
    """Frames with the planes that ``f`` makes of theirs; width and height follow from the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                out = f(planes(row), row)
                new = row._asdict()
                new |= {"height": out[0].shape[0], "width": out[0].shape[1]}
                new |= {p: np.ascontiguousarray(x, np.uint8).tobytes() for p, x in zip("yuv", out, strict=True)}
                rows.append(new)
            yield pd.DataFrame(rows, columns=pdf.columns)

    return frames.mapInPandas(run, frames.schema)


def crop(frames: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    if any(v % 2 for v in (x, y)):
        raise ValueError("the corner must be even")
    return apply(frames, lambda p, _: [p[0][y : y + height, x : x + width], *[c[y // 2 : (y + height + 1) // 2, x // 2 : (x + width + 1) // 2] for c in p[1:]]])


def pad(frames: DataFrame, width: int, height: int, x: int, y: int, fill: tuple[int, int, int] = (16, 128, 128)) -> DataFrame:
    def one(p: list[np.ndarray], _) -> list[np.ndarray]:
        out = [np.full((height, width), fill[0], np.uint8)] + [np.full(((height + 1) // 2, (width + 1) // 2), v, np.uint8) for v in fill[1:]]
        for k, (o, c) in enumerate(zip(out, p, strict=True)):
            a, b = (y, x) if k == 0 else (y // 2, x // 2)
            o[a : a + c.shape[0], b : b + c.shape[1]] = c[: o.shape[0] - a, : o.shape[1] - b]
        return out

    return apply(frames, one)


def rotate(frames: DataFrame, degrees: int) -> DataFrame:
    if degrees % 90:
        raise ValueError("degrees must be a multiple of 90")
    return apply(frames, lambda p, _: [np.rot90(c, -degrees // 90) for c in p])


def box_blur(frames: DataFrame, luma: int, chroma: int, passes: int = 1) -> DataFrame:
    """Edge-replicated box of radius ``luma`` and ``chroma``, half-up in single precision."""

    def blur(c: np.ndarray, r: int) -> np.ndarray:
        for _ in range(passes if r else 0):
            e = np.pad(c.astype(np.int64), r, mode="edge")
            s = np.pad(e.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            n = 2 * r + 1
            total = s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]
            c = (total.astype(np.float32) * np.float32(np.float32(1) / np.float32(n) / np.float32(n)) + np.float32(0.5)).astype(np.uint8)
        return c

    return apply(frames, lambda p, _: [blur(p[0], luma), blur(p[1], chroma), blur(p[2], chroma)])


def scale_weights(source: int, target: int, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """First source index and 14-bit weights of each target pixel; rounding errors go to the largest weight."""
    radius = {"bilinear": 1, "bicubic": 2, "lanczos": 3}[kernel]
    ratio = source / target
    stretch = max(1.0, ratio)
    centre = (np.arange(target) + 0.5) * ratio - 0.5
    first = np.floor(centre - radius * stretch).astype(np.int64) + 1
    taps = int(np.ceil(2 * radius * stretch)) + 1
    x = np.abs((first[:, None] + np.arange(taps)[None, :] - centre[:, None]) / stretch)
    if kernel == "bilinear":
        w = np.clip(1 - x, 0, None)
    elif kernel == "bicubic":
        a = -0.6
        w = np.where(x < 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * (x**3 - 5 * x**2 + 8 * x - 4), 0))
    else:
        w = np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)
    w = w / w.sum(axis=1, keepdims=True) * (1 << 14)
    q = np.rint(w).astype(np.int64)
    rows = np.arange(target)
    q[rows, np.abs(q).argmax(axis=1)] += (1 << 14) - q.sum(axis=1)
    return first, q


def scale_plane(c: np.ndarray, height: int, width: int, kernel: str) -> np.ndarray:
    def along(x: np.ndarray, size: int) -> np.ndarray:
        first, w = scale_weights(x.shape[1], size, kernel)
        index = np.clip(first[:, None] + np.arange(w.shape[1])[None, :], 0, x.shape[1] - 1)
        return (x[:, index] * w[None]).sum(axis=2)

    wide = (along(c.astype(np.int64), width) + (1 << 7)) >> 8
    out = (along(wide.T, height).T + (1 << 19)) >> 20
    return np.clip(out, 0, 255).astype(np.uint8)


def scale(frames: DataFrame, width: int, height: int, kernel: str = "bicubic") -> DataFrame:
    half = ((height + 1) // 2, (width + 1) // 2)
    return apply(frames, lambda p, _: [scale_plane(p[0], height, width, kernel), *[scale_plane(c, *half, kernel) for c in p[1:]]])


def fit_plan(width: int, height: int, to_width: int, to_height: int, mode: str) -> tuple[int, int]:
    """Size of a frame that is contained in, or covers, a canvas; even where the canvas is."""
    if mode not in ("contain", "cover"):
        raise ValueError(f"unknown mode {mode}")
    by_width = (to_width * height <= to_height * width) == (mode == "contain")
    w, h = (to_width, round(height * to_width / width)) if by_width else (round(width * to_height / height), to_height)
    return (w + w % 2 if to_width % 2 == 0 else w), (h + h % 2 if to_height % 2 == 0 else h)


def fade(frames: DataFrame, start: int, length: int, out: bool, colour: tuple[int, int, int] = (16, 128, 128)) -> DataFrame:
    """Fade from or to a colour over [start, start + length) of ts_ticks, in 256ths."""

    def one(p: list[np.ndarray], row) -> list[np.ndarray]:
        amount = min(1.0, max(0.0, (row.ts_ticks - start) / length)) if length else float(row.ts_ticks >= start)
        w = round((amount if out else 1 - amount) * 256)
        return [(c.astype(np.int64) * (256 - w) + k * w + 128 >> 8).astype(np.uint8) for c, k in zip(p, colour, strict=True)]

    return apply(frames, one)


def pixels(frames: DataFrame, plane: str = "y") -> DataFrame:
    """One row (frame_no, x, y, value) for each pixel of a plane."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                c = planes(row)["yuv".index(plane)]
                y, x = np.indices(c.shape, np.int32)
                yield pd.DataFrame({"frame_no": row.frame_no, "x": x.reshape(-1), "y": y.reshape(-1), "value": c.reshape(-1).astype(np.int32)})

    return frames.mapInPandas(run, "frame_no long, x int, y int, value int")


def _byte(x: np.ndarray) -> np.ndarray:
    """Rounded half away from zero, within a byte."""
    return np.clip(np.floor(np.abs(x) + 0.5) * np.sign(x), 0, 255).astype(np.uint8)


def _spread(c: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A chroma plane at the size of the luma plane, each value over its 2 by 2 pixels."""
    return np.repeat(np.repeat(c, 2, axis=0), 2, axis=1)[: shape[0], : shape[1]]


def _cell_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the 2 by 2 cells of a plane, whose last row and column may be single."""
    h, w = x.shape
    even = np.pad(x, ((0, h % 2), (0, w % 2)))
    return even.reshape((h + 1) // 2, 2, (w + 1) // 2, 2).sum(axis=(1, 3))


def colour_convert(frames: DataFrame, source: tuple[str, bool], target: tuple[str, bool]) -> DataFrame:
    """Frames from one (matrix, full range) to another; chroma is converted with the mean luma of its pixels."""
    m = conversion_matrix(source[0], target[0])
    luma_in, zero_in, chroma_in = (255.0, 0, 255.0) if source[1] else (219.0, 16, 224.0)
    luma_out, zero_out, chroma_out = (255.0, 0, 255.0) if target[1] else (219.0, 16, 224.0)

    def one(p: list[np.ndarray], _) -> list[np.ndarray]:
        y, u, v = (c.astype(np.int64) for c in p)
        cb, cr = (u - 128) / chroma_in, (v - 128) / chroma_in
        full = [(y - zero_in) / luma_in, _spread(cb, y.shape), _spread(cr, y.shape)]
        count = _cell_sums(np.ones_like(y))
        mean = ((_cell_sums(y) + count // 2) // count - zero_in) / luma_in
        out = [_byte(zero_out + luma_out * (m[0][0] * full[0] + m[0][1] * full[1] + m[0][2] * full[2]))]
        return out + [_byte(128 + chroma_out * (m[k][0] * mean + m[k][1] * cb + m[k][2] * cr)) for k in (1, 2)]

    return frames if source == target else apply(frames, one)


def composite(p: list[np.ndarray], x: int, y: int, layer: list[np.ndarray], alpha: np.ndarray) -> list[np.ndarray]:
    """Planes with a layer (y, u and v for each of its pixels) laid over them at a corner; chroma is weighted over its pixels."""
    h, w = p[0].shape
    top, left, bottom, right = max(y, 0), max(x, 0), min(y + alpha.shape[0], h), min(x + alpha.shape[1], w)
    if top >= bottom or left >= right:
        return p
    cut = (slice(top - y, bottom - y), slice(left - x, right - x))
    place = (slice(top, bottom), slice(left, right))
    a = np.zeros((h, w), np.int64)
    a[place] = alpha[cut]
    out = []
    for k, c in enumerate(p):
        own = np.zeros((h, w), np.int64)
        own[place] = layer[k][cut]
        if k == 0:
            out.append(((c.astype(np.int64) * (255 - a) + own * a + 127) // 255).astype(np.uint8))
            continue
        weight, total = 255 * _cell_sums(np.ones((h, w), np.int64)), _cell_sums(a)
        mixed = (c.astype(np.int64) * (weight - total) + _cell_sums(own * a) + weight // 2) // weight
        out.append(np.where(total > 0, mixed, c).astype(np.uint8))
    return out


def blend_mask(frames: DataFrame, mask: np.ndarray, x: int, y: int, colour: tuple[int, int, int], alpha: int = 255) -> DataFrame:
    """A colour (y, u, v) laid over frames where a coverage mask says so."""
    cover = (mask.astype(np.int64) * alpha + 127) // 255
    layer = [np.full(mask.shape, c, np.int64) for c in colour]
    return frames if alpha == 0 or not mask.size else apply(frames, lambda p, _: composite(p, x, y, layer, cover))


def fill_rectangle(frames: DataFrame, x: int, y: int, width: int, height: int, colour: tuple[int, int, int], alpha: int = 255, start: int | None = None, end: int | None = None) -> DataFrame:
    """A box of one colour laid over frames, from ``start`` to ``end`` of ts_ticks where given."""
    if width <= 0 or height <= 0 or not alpha:
        return frames
    layer, cover = [np.full((height, width), c, np.int64) for c in colour], np.full((height, width), alpha, np.int64)

    def one(p: list[np.ndarray], row) -> list[np.ndarray]:
        late = start is not None and row.ts_ticks < start or end is not None and row.ts_ticks >= end
        return p if late else composite(p, x, y, layer, cover)

    return apply(frames, one)


def pipeline(frames: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Frames through transforms, one after the other."""
    for step in steps:
        frames = step(frames)
    return frames
