"""Queries of raster files and of grids in other reference systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions import columns as fn
from terracell.operators import align
from terracell.sources import raster, tiles
from terracell.sources.grid import GRID_SQL, grid, table
from terracell.sources.shared import shared_path

from .catalog import query

G = f"WITH {GRID_SQL} "
#: The reference grid's transform and the code of its system.
TRANSFORM, EPSG = (30.0, 0.0, 628003.1242, 0.0, -30.0, 1139192.0464), 32643


def _written(spark, sf_dir, **how) -> str:
    """The grid's flow and elevation as sheets of 64 cells in blocks of 32."""
    path = shared_path(spark, "rasters")
    raster.write_raster(grid(spark, sf_dir), path, ["flow", "dem"], TRANSFORM, EPSG, dtype="float64", block=32, sheet=64, **how)
    return path


@query(G + "SELECT r, c, flow, dem FROM grid")
def raster_round_trip(spark, sf_dir):
    """The whole grid written as LZW sheets and read back; sentinels in the file, NULL in the table."""
    return raster.read_raster(spark, _written(spark, sf_dir), "flow,dem")


@query(G + ", e AS (SELECT max(r) // 3 AS lo, 2 * (max(r) // 3) + 5 AS hi FROM grid) SELECT r, c, dem FROM grid, e WHERE r >= lo AND r < hi AND c >= 20 AND c < 77")
def raster_window(spark, sf_dir):
    """One band of a window of a Deflate raster; other sheets are not opened, other blocks not read."""
    path = _written(spark, sf_dir, compression="deflate")
    third = grid(spark, sf_dir).agg(F.max("r")).first()[0] // 3
    return raster.read_raster(spark, path, "dem=1", (third, 2 * third + 5), (20, 77))


@query(G + """, e AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM grid), s AS (SELECT i.i AS sr, j.j AS sc, least(64, h - 64 * i.i)::INT AS height, least(64, w - 64 * j.j)::INT AS width
  FROM e, (SELECT unnest(range((SELECT (h + 63) // 64 FROM e))) AS i) i, (SELECT unnest(range((SELECT (w + 63) // 64 FROM e))) AS j) j)
SELECT 'sheet_' || sr || '_' || sc AS sheet, height, width, 2 AS bands, 'float64' AS dtype, 5 AS compression, (((height + 31) // 32) * ((width + 31) // 32))::INT AS blocks, -9999e0 AS nodata, 32643 AS epsg,
  30e0 AS cell, round(628003.1242e0 + 30 * 64 * sc, 4) AS west, round(1139192.0464e0 - 30 * 64 * sr, 4) AS north FROM s""")
def raster_metadata(spark, sf_dir):
    """Size, type, nodata, reference system and place of each written sheet, from its tags."""
    c = raster.raster_catalog(spark, _written(spark, sf_dir))
    t = lambda k: F.col("transform")[k]
    sheet = F.regexp_extract("path", "(sheet_[0-9]+_[0-9]+)-", 1).alias("sheet")
    return c.select(sheet, "height", "width", "bands", "dtype", "compression", "blocks", "nodata", "epsg", t(0).alias("cell"), F.round(t(2), 4).alias("west"), F.round(t(5), 4).alias("north"))


@query(G + ", e AS (SELECT max(r) + 1 AS h FROM grid), b AS (SELECT DISTINCT (n_nationkey * 37 % h // 16)::INT AS tile_r, (n_nationkey * 29 % 100 // 16)::INT AS tile_c FROM nation, e) SELECT tile_r, tile_c, count(*) AS cells, round(sum(flow), 6) AS flow, count(dem) AS heights FROM grid JOIN b ON r // 16 = tile_r AND c // 16 = tile_c GROUP BY ALL")
def block_reads(spark, sf_dir):
    """Sums of the blocks that a table of places asks for, from the grid stored by tiles."""
    path = shared_path(spark, "tiles")
    cells = grid(spark, sf_dir)
    tiles.write_tiles(cells.select("r", "c", "flow", "dem"), path, 16)
    extent = F.broadcast(cells.agg((F.max("r") + 1).alias("_h")))  # one row
    k = F.col("n_nationkey")
    wanted = table(spark, sf_dir, "nation").crossJoin(extent).select(F.floor(k * 37 % F.col("_h") / 16).cast("int").alias("tile_r"), F.floor(k * 29 % 100 / 16).cast("int").alias("tile_c"))
    return tiles.read_blocks(spark, path, wanted).groupBy("tile_r", "tile_c").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("flow"), 6).alias("flow"), F.count("dem").alias("heights"))


# ---- longitude and latitude to UTM

#: The grid taken as cells of 0.00027 degrees, and cells of 30 m around it.
DEGREES, METRES = (0.00027, 0.0, 76.2, 0.0, -0.00027, 10.1), (30.0, 0.0, 631480.0, 0.0, -30.0, 1116880.0)


def _from_utm_sql(x: str, y: str) -> str:
    """lon, lat of eastings and northings, as a list of steps for nested selects."""
    scale = fn._K0 * fn._RADIUS
    terms = lambda coefficients, f, g: "".join(f" - {b!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, b in enumerate(coefficients, 1))
    delta = "".join(f" + {d!r} * sin({2 * j} * chi)" for j, d in enumerate(fn._DELTA, 1))
    return f"""u1 AS (SELECT r, c, ({y}) / {scale!r} AS xi, (({x}) - {fn._E0!r}) / {scale!r} AS eta FROM t),
u2 AS (SELECT r, c, eta{terms(fn._BETA, 'cos', 'sinh')} AS ux, xi{terms(fn._BETA, 'sin', 'cosh')} AS uy FROM u1),
u3 AS (SELECT r, c, 75e0 + degrees(atan2(sinh(ux), cos(uy))) AS lon, asin(sin(uy) / cosh(ux)) AS chi FROM u2),
u4 AS (SELECT r, c, lon, degrees(chi{delta}) AS lat FROM u3),
u AS (SELECT r, c, (lat - {DEGREES[5]!r}) / {DEGREES[4]!r} AS y, (lon - {DEGREES[2]!r}) / {DEGREES[0]!r} AS x FROM u4)"""


_UTM_SQL = G + f""", t AS (SELECT i AS r, j AS c FROM (SELECT unnest(range((SELECT max(r) + 10 FROM grid))) AS i) a, (SELECT unnest(range((SELECT max(c) + 10 FROM grid))) AS j) b),
{_from_utm_sql('631480e0 + 30 * (c + 0.5e0)', '1116880e0 - 30 * (r + 0.5e0)')},
k AS (SELECT u.r, u.c, n.dem, (1 - abs(u.y - 0.5e0 - n.r)) * (1 - abs(u.x - 0.5e0 - n.c)) AS w FROM u LEFT JOIN grid n
  ON n.r BETWEEN floor(u.y - 0.5e0)::INT AND floor(u.y - 0.5e0)::INT + 1 AND n.c BETWEEN floor(u.x - 0.5e0)::INT AND floor(u.x - 0.5e0)::INT + 1),
m AS (SELECT r, c, round(sum(w * dem) FILTER (WHERE dem IS NOT NULL) / nullif(sum(w) FILTER (WHERE dem IS NOT NULL), 0), 5) AS dem FROM k GROUP BY r, c)
SELECT m.r::INT AS r, m.c::INT AS c, m.dem, g.lulc::DOUBLE AS lulc FROM m JOIN u ON m.r = u.r AND m.c = u.c LEFT JOIN grid g ON g.r = floor(u.y)::INT AND g.c = floor(u.x)::INT"""


@query(_UTM_SQL)
def reproject_to_utm(spark, sf_dir):
    """A grid of degrees on a grid of 30 m: elevation between cells, land cover from the nearest."""
    cells = grid(spark, sf_dir).select("r", "c", "dem", "lulc")
    extent = cells.agg((F.max("r") + 10).alias("h"), (F.max("c") + 10).alias("w"))
    tiles = align.target_tiles(F.col("h"), F.col("w"), extent, 64)
    out = align.reproject(cells, DEGREES, tiles, METRES, fn.from_utm, ["lulc"], ["dem"], tile=64)
    return out.select("r", "c", F.round("dem", 5).alias("dem"), "lulc")
