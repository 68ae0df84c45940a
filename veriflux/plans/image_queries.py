"""Queries of image and score-map kernels, over vectors taken as 8 x 8 grids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import image as I
from . import frames as S
from .registry import query
from .stat_queries import _maps

#: A grid of doubles, and a grey picture of 8 bits, of each vector; cells y, x.
GRID_SQL = "c AS (SELECT vec_id AS frame_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS s FROM embeddings), xy AS (SELECT CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, i FROM range(64) r(i))"
PICTURE_SQL = GRID_SQL + ", p AS (SELECT frame_id, [CAST(floor((v + 1) * 127.5) AS INTEGER) FOR v IN s] AS p FROM c)"


def _picture(scores: np.ndarray) -> np.ndarray:
    return np.floor((np.asarray(scores).reshape(8, 8) + 1) * 127.5).astype(np.uint8)


def _cells(spark, sf_dir, kernel: Callable[[np.ndarray], np.ndarray], columns: str = "value") -> DataFrame:
    """frame_id, y, x and the kernel's values of each grid, a column for each channel."""
    I.ship_package(spark)
    names = columns.split()

    def run(batches):
        for pdf in batches:
            for k, s in zip(pdf["frame_id"], pdf["scores"]):
                out = kernel(np.asarray(s))
                h, w = out.shape[:2]
                flat = out.reshape(h * w, -1).astype(float)
                yield pd.DataFrame({"frame_id": k, "y": np.repeat(np.arange(h), w), "x": np.tile(np.arange(w), h), **{n: flat[:, i].round(6) for i, n in enumerate(names)}})

    return _maps(spark, sf_dir).mapInPandas(run, "frame_id long, y int, x int, " + ", ".join(f"{n} double" for n in names))


@query(f"WITH {PICTURE_SQL} SELECT frame_id, y, x, CAST(floor(least(255, p[i + 1] * 131.5 / (100 + i))) AS DOUBLE) AS value FROM p, xy")
def i2_flat_field(spark, sf_dir):
    reference = np.arange(100, 164, dtype=np.uint8).reshape(8, 8)
    return _cells(spark, sf_dir, lambda s: I.flat_field(_picture(s), reference))


@query(f"WITH {PICTURE_SQL} SELECT frame_id, y, x, CAST(p[y // 2 * 16 + x // 2 * 2 + 1] AS DOUBLE) AS r, CAST(p[y // 2 * 16 + x // 2 * 2 + 2] AS DOUBLE) AS g, CAST(p[y // 2 * 16 + x // 2 * 2 + 10] AS DOUBLE) AS b FROM p, xy")
def i3_debayer(spark, sf_dir):
    return _cells(spark, sf_dir, lambda s: I.debayer_rggb(_picture(s)), "r g b")


@query(f"WITH {PICTURE_SQL} SELECT frame_id, y, x, CAST(floor(least(255, p[y // 2 * 16 + x // 2 * 2 + 1] * 1.5)) AS DOUBLE) AS r, CAST(p[y // 2 * 16 + x // 2 * 2 + 2] AS DOUBLE) AS g, CAST(floor(least(255, p[y // 2 * 16 + x // 2 * 2 + 10] * 0.75)) AS DOUBLE) AS b FROM p, xy WHERE y >= 2 AND y < 6 AND x >= 2 AND x < 6".replace("frame_id, y, x,", "frame_id, y - 2 AS y, x - 2 AS x,"))
def i1_compose(spark, sf_dir):
    """Debayering, white balance and a cut, one after another."""
    steps = I.compose([I.debayer_rggb, lambda x: I.white_balance(x, (1.5, 1.0, 0.75)), lambda x: I.crop(x, I.bounding_box([(2, 2, 3, 4), (4, 3, 2, 3)]))])
    return _cells(spark, sf_dir, lambda s: steps(_picture(s)), "r g b")


@query(f"WITH {PICTURE_SQL}, q AS (SELECT *, list_min(p) AS lo, list_max(p) AS hi FROM p) SELECT frame_id, y, x, CAST(CASE WHEN hi = lo THEN p[i + 1] ELSE floor((p[i + 1] - lo) * 255.0::DOUBLE / (hi - lo)) END AS DOUBLE) AS value FROM q, xy")
def i7_stretch(spark, sf_dir):
    return _cells(spark, sf_dir, lambda s: I.stretch(_picture(s).astype(float)))


@query(f"""WITH {GRID_SQL}, d AS (SELECT i, y, x, (x - 3.5) / 6 AS a, (y - 3.5) / 6 AS b FROM xy), r AS (SELECT i, y, x, 6 * (a * (1 + 0.3::DOUBLE * (a * a + b * b))) + 3.5 AS u, 6 * (b * (1 + 0.3::DOUBLE * (a * a + b * b))) + 3.5 AS v FROM d),
n AS (SELECT *, u >= 0 AND v >= 0 AND u <= 7 AND v <= 7 AS inside, CAST(greatest(0, least(7, floor(u))) AS INTEGER) AS u0, CAST(greatest(0, least(7, floor(v))) AS INTEGER) AS v0 FROM r)
SELECT frame_id, y, x, round(CASE WHEN inside THEN (s[v0 * 8 + u0 + 1] * (1 - (u - u0)) + s[v0 * 8 + least(u0 + 1, 7) + 1] * (u - u0)) * (1 - (v - v0)) + (s[least(v0 + 1, 7) * 8 + u0 + 1] * (1 - (u - u0)) + s[least(v0 + 1, 7) * 8 + least(u0 + 1, 7) + 1] * (u - u0)) * (v - v0) ELSE 0 END, 6) AS value FROM c, n""")
def i6_undistort(spark, sf_dir):
    return _cells(spark, sf_dir, lambda s: I.undistort(s.reshape(8, 8), 6.0, 6.0, 3.5, 3.5, (0.3, 0.0, 0.0, 0.0, 0.0)))


@query(f"WITH {GRID_SQL}, l AS (SELECT frame_id, [(s[j] + s[j + 16] + s[j + 32] + s[j + 48]) / 4 FOR j IN range(1, 17)] || [(s[j] + s[j + 16]) / 2 FOR j IN range(1, 17)] || [s[j] / 2 FOR j IN range(33, 49)] AS v FROM c) SELECT frame_id, CAST(0 AS INTEGER) AS y, CAST(j - 1 AS INTEGER) AS x, round(v[j], 6) AS value FROM l, range(1, 49) r(j)")
def i10_layers(spark, sf_dir):
    """The mean of four layers; then the means of two groups, of which the second lacks a layer."""
    def run(s):
        x = list(s.reshape(4, 16))
        return np.concatenate([I.aggregate_layers(x), I.aggregate_layers([x[0], x[1], x[2], None], "group", [[0, 1], [2, 3]])])[None]

    return _cells(spark, sf_dir, run)


@query(f"WITH {GRID_SQL}, m AS (SELECT frame_id, [list_sum([s[h * 8 + j] FOR h IN range(8)]) / 8 FOR j IN range(1, 9)] AS v FROM c) SELECT frame_id, CAST(0 AS INTEGER) AS y, CAST(j - 1 AS INTEGER) AS x, round(v[j], 6) AS value, CAST(round(v[j], 9) >= round(list_sort(v)[6], 9) AS DOUBLE) AS mask FROM m, range(1, 9) r(j)")
def i11_saliency(spark, sf_dir):
    def run(s):
        m = I.saliency(s.reshape(2, 4, 8))
        return np.stack([m, I.binarise(m)], axis=-1)[None]

    return _cells(spark, sf_dir, run, "value mask")


#: Separable blur by one column of the grids ``g`` (frame_id, y, x, value) of n x n cells.
def blur_sql(source: str, n: int, sigma: float, name: str) -> str:
    r = int(np.ceil(3 * sigma))
    return f"""k_{name} AS (SELECT j, exp(-0.5 * (j / {sigma}::DOUBLE) ** 2) / sum(exp(-0.5 * (j / {sigma}::DOUBLE) ** 2)) OVER () AS k FROM range({-r}, {r + 1}) r(j)),
v_{name} AS (SELECT g.frame_id, t.o AS y, g.x, sum(k * value) AS value FROM range({n}) t(o) CROSS JOIN k_{name} JOIN {source} g ON g.y = greatest(0, least({n - 1}, t.o + j)) GROUP BY ALL),
{name} AS (SELECT g.frame_id, g.y, t.o AS x, sum(k * value) AS value FROM range({n}) t(o) CROSS JOIN k_{name} JOIN v_{name} g ON g.x = greatest(0, least({n - 1}, t.o + j)) GROUP BY ALL)"""


@query(f"WITH {GRID_SQL}, g AS (SELECT frame_id, y, x, s[i + 1] AS value FROM c, xy), {blur_sql('g', 8, 0.5, 'b')} SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(value, 6) AS value FROM b")
def i14_blur(spark, sf_dir):
    return _cells(spark, sf_dir, lambda s: I.gaussian_blur(s.reshape(8, 8), 0.5))


def regions_sql(cells: str, threshold: float) -> str:
    """``regions``: the 4-connected components of cells over a threshold, the largest maximum first."""
    return f"""over_ AS (SELECT frame_id, y, x, value FROM {cells} WHERE value > {threshold}), reach(frame_id, y, x, ry, rx) AS (
  SELECT frame_id, y, x, y, x FROM over_ UNION SELECT o.frame_id, o.y, o.x, ry, rx FROM reach r JOIN over_ o ON o.frame_id = r.frame_id AND abs(o.y - r.y) + abs(o.x - r.x) = 1
), root AS (SELECT frame_id, y, x, min(ry * 100 + rx) AS root FROM reach GROUP BY ALL), comp AS (
  SELECT frame_id, root, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, max(value) AS max_score, avg(value) AS mean_score FROM root JOIN over_ USING (frame_id, y, x) GROUP BY ALL
), regions AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY max_score DESC, y0, x0) - 1 AS region FROM comp)"""


@query(f"""WITH RECURSIVE {GRID_SQL}, a AS (SELECT o, greatest(0, least(7, (o + 0.5) / 2 - 0.5)) AS p FROM range(16) r(o)), b AS (SELECT o, CAST(floor(p) AS INTEGER) AS lo, least(CAST(floor(p) AS INTEGER) + 1, 7) AS hi, p - floor(p) AS f FROM a),
g AS (SELECT frame_id, y.o AS y, x.o AS x, (s[y.lo * 8 + x.lo + 1] * (1 - x.f) + s[y.lo * 8 + x.hi + 1] * x.f) * (1 - y.f) + (s[y.hi * 8 + x.lo + 1] * (1 - x.f) + s[y.hi * 8 + x.hi + 1] * x.f) * y.f AS value FROM c, b y, b x),
{blur_sql('g', 16, 1.0, 'bl')}, {regions_sql('bl', 0.05)}
SELECT frame_id, round(list_max(s), 6) AS image_score, CAST(region AS INTEGER) AS region, CAST(x0 AS INTEGER) AS x, CAST(y0 AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, CAST(area AS INTEGER) AS area, round(max_score, 6) AS max_score FROM c LEFT JOIN regions USING (frame_id)""")
def i17_detection(spark, sf_dir):
    """Upsampling, blur, threshold, components and image score."""
    out = I.detect(_maps(spark, sf_dir), (8, 8), (16, 16), 1.0, 0.05)
    return out.select("frame_id", F.round("image_score", 6).alias("image_score"), "region", "x", "y", "w", "h", "area", F.round("max_score", 6).alias("max_score"))
