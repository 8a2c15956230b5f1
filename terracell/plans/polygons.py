"""Queries of cells inside districts of several rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.operators import polygons
from terracell.sources.grid import GRID_SQL, grid, table

from .catalog import query

#: Corners (x in columns, y as a share of the rows) around a district's middle: its outer ring, a hole, and a far part.
RINGS = [
    [(-14.3, -0.11), (1.7, -0.163), (13.1, -0.047), (9.9, 0.121), (-3.3, 0.083), (-12.7, 0.147)],
    [(-4.1, -0.031), (3.7, -0.053), (2.9, 0.037), (-2.3, 0.029)],
    [(15.3, 0.113), (22.9, 0.067), (19.7, 0.171)],
]
_POINTS = ", ".join(f"({k}, {i}, {x}e0, {y}e0)" for k, ring in enumerate(RINGS) for i, (x, y) in enumerate(ring))
_SQL = f"""WITH {GRID_SQL}, h AS (SELECT max(r) + 1 AS h FROM grid), o(ring, point, dx, dy) AS (VALUES {_POINTS}),
p AS (SELECT n_nationkey AS feature, ring, point, 11 + 3.17e0 * n_nationkey + dx AS x, h * (0.17e0 + 0.0277e0 * (n_nationkey * 7 % 25) + dy) AS y FROM nation, o, h),
e AS (SELECT feature, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM p WINDOW w AS (PARTITION BY feature, ring ORDER BY point)),
i AS (SELECT feature, r, c FROM grid JOIN e ON (y0 > r + 0.5e0) <> (y1 > r + 0.5e0) WHERE c + 0.5e0 < (x1 - x0) * (r + 0.5e0 - y0) / (y1 - y0) + x0 GROUP BY ALL HAVING count(*) % 2 = 1)
"""


@query(_SQL + "SELECT n_name AS district, count(i.r) AS cells, round(avg(flow), 6) AS mean_flow, count(*) FILTER (WHERE lulc = 80) AS water FROM i JOIN grid USING (r, c) JOIN nation ON n_nationkey = feature GROUP BY n_name")
def district_counts(spark, sf_dir):
    """Cells of each district: an outer ring, a hole and a second part, several districts over one cell."""
    cells = grid(spark, sf_dir).select("r", "c", "flow", "lulc")
    height = F.broadcast(cells.agg((F.max("r") + 1).alias("_h")))  # one row
    corners = [F.struct(F.lit(k).alias("ring"), F.lit(i).alias("point"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for k, ring in enumerate(RINGS) for i, (x, y) in enumerate(ring)]
    k = F.col("n_nationkey")
    each = table(spark, sf_dir, "nation").select(k, F.explode(F.array(*corners)).alias("o")).crossJoin(height)
    x, y = F.lit(11) + F.lit(3.17) * k + F.col("o.dx"), F.col("_h") * (F.lit(0.17) + F.lit(0.0277) * (k * 7 % 25) + F.col("o.dy"))
    held = polygons.inside(cells, each.select(k.alias("feature"), "o.ring", "o.point", x.alias("x"), y.alias("y")))
    by = held.groupBy("feature").agg(F.count("r").alias("cells"), F.round(F.avg("flow"), 6).alias("mean_flow"), F.count_if(F.col("lulc") == 80).alias("water"))
    names = table(spark, sf_dir, "nation").select(k.alias("feature"), F.col("n_name").alias("district"))
    return by.join(names, "feature").select("district", "cells", "mean_flow", "water")
