"""Queries on whole frames: 16 by 16 pictures from part, a picture for each 256 parts, the last one filled up with zeros."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wavelattice.operators import frames as fr
from wavelattice.operators import pointwise as pw
from wavelattice.plans.registry import query
from wavelattice.plans.tables import read

# Luma from the size, chroma from the key of the first 64 and the next 64 parts of a picture.
_GRID = """RECURSIVE n AS (SELECT max(p_partkey // 256) AS last FROM part), g AS (SELECT CAST(f AS BIGINT) AS frame_no, CAST(i AS INTEGER) AS i FROM n, unnest(range(last + 1)) a(f), unnest(range(256)) b(i)),
  v AS (SELECT frame_no, i, coalesce(p_size * 5 % 256, 0) AS l, coalesce(p_partkey * 7 % 256, 0) AS c FROM g LEFT JOIN part ON p_partkey = frame_no * 256 + i),
  y AS (SELECT frame_no, i % 16 AS x, i // 16 AS y, CAST(l AS INTEGER) AS value FROM v),
  u AS (SELECT frame_no, i % 8 AS x, i // 8 AS y, CAST(c AS INTEGER) AS value FROM v WHERE i < 64),
  w AS (SELECT frame_no, (i - 64) % 8 AS x, (i - 64) // 8 AS y, CAST(c AS INTEGER) AS value FROM v WHERE i BETWEEN 64 AND 127)"""
G = f"WITH {_GRID}"
_OUT = "SELECT frame_no, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST({value} AS INTEGER) AS value FROM {table}"


def _frames(spark, sf_dir):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((2, 256), np.int64)
        grid[:, pdf["i"]] = pdf["l"], pdf["c"]
        luma, chroma = grid.astype(np.uint8)
        n = int(pdf["frame_no"].iloc[0])
        return pd.DataFrame({"frame_no": [n], "ts_ticks": [n * 40], "width": [16], "height": [16], "y": [luma.tobytes()], "u": [chroma[:64].tobytes()], "v": [chroma[64:128].tobytes()]})

    at = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(F.floor(at / 256).alias("frame_no"), (at % 256).cast("int").alias("i"), (F.col("p_size") * 5 % 256).alias("l"), (F.col("p_partkey") * 7 % 256).alias("c"))
    return rows.groupBy("frame_no").applyInPandas(run, "frame_no long, ts_ticks long, width int, height int, y binary, u binary, v binary")


@query("frame_crop", f"{G} SELECT frame_no, CAST(x - 4 AS INTEGER) AS x, CAST(y - 2 AS INTEGER) AS y, value FROM y WHERE x BETWEEN 4 AND 11 AND y BETWEEN 2 AND 7")
def frame_crop(spark, sf_dir):
    return fr.pixels(fr.crop(_frames(spark, sf_dir), 4, 2, 8, 6))


@query("frame_pad", f"""{G} SELECT a.frame_no, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, CAST(coalesce(u.value, 128) AS INTEGER) AS value
    FROM (SELECT frame_no, p % 12 AS x, p // 12 AS y FROM (SELECT DISTINCT frame_no FROM g), unnest(range(120)) t(p)) a LEFT JOIN u ON u.frame_no = a.frame_no AND u.x = a.x - 2 AND u.y = a.y - 1""")
def frame_pad(spark, sf_dir):
    return fr.pixels(fr.pad(_frames(spark, sf_dir), 24, 20, 4, 2), "u")


@query("frame_rotate", f"{G} SELECT frame_no, CAST(15 - y AS INTEGER) AS x, CAST(x AS INTEGER) AS y, value FROM y")
def frame_rotate(spark, sf_dir):
    return fr.pixels(fr.rotate(_frames(spark, sf_dir), 90))


# Halving by bilinear weights: four taps of 2048, 6144, 6144 and 2048 along each axis, in two rounded passes.
@query("frame_scale", f"""{G}, k AS (SELECT * FROM (VALUES (-1, 2048), (0, 6144), (1, 6144), (2, 2048)) t(d, c)), o AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS o),
    h AS (SELECT frame_no, o.o AS x, a.y, (sum(a.value * c) + 128) >> 8 AS value FROM o, k JOIN y a ON true WHERE a.x = greatest(0, least(15, 2 * o.o + d)) GROUP BY ALL),
    r AS (SELECT frame_no, h.x, o.o AS y, (sum(h.value * c) + 524288) >> 20 AS value FROM o, k JOIN h ON true WHERE h.y = greatest(0, least(15, 2 * o.o + d)) GROUP BY frame_no, h.x, o.o)
    SELECT frame_no, x, y, CAST(greatest(0, least(255, value)) AS INTEGER) AS value FROM r""")
def frame_scale(spark, sf_dir):
    return fr.pixels(fr.scale(_frames(spark, sf_dir), 8, 8, "bilinear"))


@query("frame_blur", f"""{G}, d AS (SELECT CAST(a AS INTEGER) AS dx, CAST(b AS INTEGER) AS dy FROM unnest(range(-1, 2)) s(a), unnest(range(-1, 2)) t(b)),
    s AS (SELECT p.frame_no, p.x, p.y, sum(q.value) AS total FROM y p, d JOIN y q ON true WHERE q.frame_no = p.frame_no AND q.x = greatest(0, least(15, p.x + dx)) AND q.y = greatest(0, least(15, p.y + dy)) GROUP BY ALL)
    SELECT frame_no, x, y, CAST(floor(CAST(total AS FLOAT) * CAST(CAST(1.0 / 3 AS FLOAT) / CAST(3 AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT)) AS INTEGER) AS value FROM s""")
def frame_blur(spark, sf_dir):
    return fr.pixels(fr.box_blur(_frames(spark, sf_dir), 1, 0))


@query("frame_fade", f"{G}, a AS (SELECT *, CAST(round_even(greatest(0, least(1, (frame_no * 40 - 40) / 160.0::DOUBLE)) * 256, 0) AS INTEGER) AS w FROM y) SELECT frame_no, x, y, CAST((value * (256 - w) + 16 * w + 128) >> 8 AS INTEGER) AS value FROM a")
def frame_fade(spark, sf_dir):
    return fr.pixels(fr.fade(_frames(spark, sf_dir), 40, 160, True))


_CONVERT = """, m AS (SELECT a.frame_no, a.x, a.y, a.value AS l, (u.value - 128) / 224.0::DOUBLE AS cb, (w.value - 128) / 224.0::DOUBLE AS cr FROM y a JOIN u ON u.frame_no = a.frame_no AND u.x = a.x // 2 AND u.y = a.y // 2 JOIN w ON w.frame_no = a.frame_no AND w.x = a.x // 2 AND w.y = a.y // 2)"""


def _matrix_sql(row: int) -> str:
    a, b, c = pw.conversion_matrix("bt601", "bt709")[row]
    return f"{a!r}::DOUBLE * {{l}} + {b!r}::DOUBLE * cb + {c!r}::DOUBLE * cr"


_BYTE = "CAST(greatest(0, least(255, floor(abs({v}) + 0.5) * sign({v}))) AS INTEGER)"


@query("colour_convert_luma", f"""{G}{_CONVERT}, o AS (SELECT frame_no, x, y, 255.0::DOUBLE * ({_matrix_sql(0).format(l="((l - 16) / 219.0::DOUBLE)")}) AS v FROM m) SELECT frame_no, x, y, {_BYTE.format(v='v')} AS value FROM o""")
def colour_convert_luma(spark, sf_dir):
    return fr.pixels(fr.colour_convert(_frames(spark, sf_dir), ("bt601", False), ("bt709", True)))


@query("colour_convert_chroma", f"""{G}, c AS (SELECT u.frame_no, u.x, u.y, (u.value - 128) / 224.0::DOUBLE AS cb, (w.value - 128) / 224.0::DOUBLE AS cr, ((SELECT sum(a.value) FROM y a WHERE a.frame_no = u.frame_no AND a.x // 2 = u.x AND a.y // 2 = u.y) + 2) // 4 AS l FROM u JOIN w USING (frame_no, x, y)),
    o AS (SELECT frame_no, x, y, 128 + 255.0::DOUBLE * ({_matrix_sql(2).format(l="((l - 16) / 219.0::DOUBLE)")}) AS v FROM c) SELECT frame_no, x, y, {_BYTE.format(v='v')} AS value FROM o""")
def colour_convert_chroma(spark, sf_dir):
    return fr.pixels(fr.colour_convert(_frames(spark, sf_dir), ("bt601", False), ("bt709", True)), "v")


@query("draw_rectangle", f"""{G} SELECT frame_no, x, y, CAST(CASE WHEN x BETWEEN 3 AND 9 AND y BETWEEN 5 AND 9 AND frame_no BETWEEN 1 AND 3 THEN (value * (255 - 100) + 200 * 100 + 127) // 255 ELSE value END AS INTEGER) AS value FROM y""")
def draw_rectangle(spark, sf_dir):
    return fr.pixels(fr.fill_rectangle(_frames(spark, sf_dir), 3, 5, 7, 5, (200, 90, 30), 100, 40, 160))


@query("draw_rectangle_chroma", f"""{G}, a AS (SELECT frame_no, u.x, u.y, value, (SELECT count(*) FROM unnest(range(4)) t(k) WHERE u.x * 2 + k % 2 BETWEEN 3 AND 9 AND u.y * 2 + k // 2 BETWEEN 5 AND 9) AS n FROM u)
    SELECT frame_no, x, y, CAST(CASE WHEN n > 0 THEN (value * (1020 - n * 100) + 90 * n * 100 + 510) // 1020 ELSE value END AS INTEGER) AS value FROM a""")
def draw_rectangle_chroma(spark, sf_dir):
    return fr.pixels(fr.fill_rectangle(_frames(spark, sf_dir), 3, 5, 7, 5, (200, 90, 30), 100), "u")


@query("blend_mask", f"""{G}, a AS (SELECT *, CASE WHEN x >= 10 AND y >= 12 THEN (((x - 10) * 40 + (y - 12) * 10) % 256 * 128 + 127) // 255 ELSE 0 END AS al FROM y) SELECT frame_no, x, y, CAST((value * (255 - al) + 235 * al + 127) // 255 AS INTEGER) AS value FROM a""")
def blend_mask(spark, sf_dir):
    mask = np.array([[(x * 40 + y * 10) % 256 for x in range(12)] for y in range(9)])
    return fr.pixels(fr.blend_mask(_frames(spark, sf_dir), mask, 10, 12, (235, 128, 128), 128))


@query("frame_pipeline", f"{G}, a AS (SELECT frame_no, x - 4 AS x, y - 2 AS y, value FROM y WHERE x BETWEEN 4 AND 11 AND y BETWEEN 2 AND 7) SELECT frame_no, CAST(5 - y AS INTEGER) AS x, CAST(x AS INTEGER) AS y, CAST((value * 55 + 16 * 200 + 127) // 255 AS INTEGER) AS value FROM a")
def frame_pipeline(spark, sf_dir):
    steps = (lambda f: fr.crop(f, 4, 2, 8, 6), lambda f: fr.rotate(f, 90), lambda f: fr.fill_rectangle(f, 0, 0, 6, 8, (16, 128, 128), 200))
    return fr.pixels(fr.pipeline(_frames(spark, sf_dir), *steps))


@query("fit_sizes", """WITH s AS (SELECT p_partkey, p_partkey % 300 + 2 AS w, p_size * 4 + 2 AS h FROM part),
    a AS (SELECT *, 160 * h <= 90 * w AS narrow FROM s),
    b AS (SELECT p_partkey, m, narrow = (m = 'contain') AS by_width, w, h FROM a, (VALUES ('contain'), ('cover')) t(m)),
    c AS (SELECT p_partkey, m, CASE WHEN by_width THEN 160 ELSE CAST(round_even(w * 90 / h::DOUBLE, 0) AS BIGINT) END AS ww, CASE WHEN by_width THEN CAST(round_even(h * 160 / w::DOUBLE, 0) AS BIGINT) ELSE 90 END AS hh FROM b)
    SELECT p_partkey, m AS mode, CAST(ww + ww % 2 AS INTEGER) AS width, CAST(hh + hh % 2 AS INTEGER) AS height FROM c""")
def fit_sizes(spark, sf_dir):
    """Sizes that fit into or cover 160 by 90, for pictures of many shapes."""

    def run(batches):
        for pdf in batches:
            for mode in ("contain", "cover"):
                sizes = [fr.fit_plan(w, h, 160, 90, mode) for w, h in zip(pdf["w"].tolist(), pdf["h"].tolist(), strict=True)]
                yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "mode": mode, "width": [s[0] for s in sizes], "height": [s[1] for s in sizes]})

    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", (k % 300 + 2).alias("w"), (F.col("p_size") * 4 + 2).alias("h")).mapInPandas(run, "p_partkey long, mode string, width int, height int")


@query("ycbcr_to_rgb", """WITH c AS (SELECT p_partkey, (p_size * 5 % 220 + 16 - 16) / 219.0::DOUBLE AS l, (p_partkey * 7 % 225 + 16 - 128) / 224.0::DOUBLE AS cb, (p_partkey * 11 % 225 + 16 - 128) / 224.0::DOUBLE AS cr FROM part),
    k AS (SELECT p_partkey, l + cr * (2 * (1 - 0.299::DOUBLE)) AS r, l + cb * (2 * (1 - 0.114::DOUBLE)) AS b, l FROM c), o AS (SELECT p_partkey, r, (l - 0.299::DOUBLE * r - 0.114::DOUBLE * b) / (1 - 0.299::DOUBLE - 0.114::DOUBLE) AS g, b FROM k)
    SELECT p_partkey, CAST(greatest(0, least(255, round(r * 255, 0))) AS INTEGER) AS r, CAST(greatest(0, least(255, round(g * 255, 0))) AS INTEGER) AS g, CAST(greatest(0, least(255, round(b * 255, 0))) AS INTEGER) AS b FROM o""")
def ycbcr_to_rgb(spark, sf_dir):
    k = F.col("p_partkey")
    r, g, b = pw.ycbcr_to_rgb(F.col("p_size") * 5 % 220 + 16, k * 7 % 225 + 16, k * 11 % 225 + 16)
    return read(spark, sf_dir, "part").select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query("colour_matrix", """WITH c AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS l, (p_partkey % 201 - 100) / 200.0::DOUBLE AS cb, (p_partkey % 101 - 50) / 100.0::DOUBLE AS cr FROM part),
    k AS (SELECT p_partkey, l, l + 2 * (1 - 0.299::DOUBLE) * cr AS r, l + 2 * (1 - 0.114::DOUBLE) * cb AS b FROM c), g AS (SELECT *, (l - 0.299::DOUBLE * r - 0.114::DOUBLE * b) / (1 - 0.299::DOUBLE - 0.114::DOUBLE) AS g FROM k),
    o AS (SELECT p_partkey, r, b, 0.2126::DOUBLE * r + (1 - 0.2126::DOUBLE - 0.0722::DOUBLE) * g + 0.0722::DOUBLE * b AS y FROM g)
    SELECT p_partkey, round(y, 9) AS luma, round((b - y) / (2 * (1 - 0.0722::DOUBLE)), 9) AS cb, round((r - y) / (2 * (1 - 0.2126::DOUBLE)), 9) AS cr FROM o""")
def colour_matrix(spark, sf_dir):
    k = F.col("p_partkey")
    y, cb, cr = pw.convert_matrix(F.col("p_size") / 50.0, (k % 201 - 100) / 200.0, (k % 101 - 50) / 100.0, "bt601", "bt709")
    return read(spark, sf_dir, "part").select("p_partkey", F.round(y, 9).alias("luma"), F.round(cb, 9).alias("cb"), F.round(cr, 9).alias("cr"))
