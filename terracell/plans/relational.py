"""Queries of joins, lookups, catalogs, time series and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions import columns as fn
from terracell.operators import align, ranks, stats
from terracell.sources import catalog as layers
from terracell.sources import scenes, tiles
from terracell.sources.grid import GRID_SQL, PLACES_SQL, grid, places, table
from terracell.streaming import rainfall

from .catalog import query

G = f"WITH {GRID_SQL} "
POINTS_SQL = "pts AS (SELECT n_name AS name, (n_nationkey % 10)::INT AS r, (n_nationkey * 4)::INT AS c FROM nation)"


def _points(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (k % 10).cast("int").alias("r"), (k * 4).cast("int").alias("c"))


_STACK_SQL = G + ", a AS (SELECT r, c, flow FROM grid), b AS (SELECT r, c, slope FROM grid) SELECT r, c, flow, slope FROM a JOIN b USING (r, c)"


@query(_STACK_SQL)
def band_stack(spark, sf_dir):
    g = grid(spark, sf_dir)
    return align.stack(g.select("r", "c", "flow"), g.select("r", "c", "slope"))


@query(_STACK_SQL)
def band_stack_all(spark, sf_dir):
    """The rows of band_stack under its second name."""
    return band_stack(spark, sf_dir)


@query(G + f", {POINTS_SQL} SELECT name, pts.r, pts.c, dem, p150, CASE WHEN p150 > 0.7 THEN 'High' WHEN p150 > 0.4 THEN 'Medium' WHEN p150 IS NOT NULL THEN 'Low' END AS level FROM pts LEFT JOIN grid ON pts.r = grid.r AND pts.c = grid.c")
def point_lookup(spark, sf_dir):
    return align.lookup(_points(spark, sf_dir), grid(spark, sf_dir), ["dem", "p150"]).withColumn("level", fn.ladder(F.col("p150"), "hotspot"))


@query(G + f", {POINTS_SQL}, m(mode) AS (VALUES ('p100'), ('p200')) SELECT name, mode, CASE mode WHEN 'p100' THEN p100 ELSE p200 END AS prob FROM pts CROSS JOIN m LEFT JOIN grid ON pts.r = grid.r AND pts.c = grid.c")
def spots_by_mode(spark, sf_dir):
    found = align.lookup(_points(spark, sf_dir), grid(spark, sf_dir), ["p100", "p200"])
    return found.select("name", F.explode(F.create_map(F.lit("p100"), F.col("p100"), F.lit("p200"), F.col("p200"))).alias("mode", "prob"))


def _series(terms: tuple[float, ...], sign: str, along: str, up: str) -> str:
    return "".join(f" {sign} ({t!r}::DOUBLE) * {along}({2 * j}e0 * xi) * {up}({2 * j}e0 * eta)" for j, t in enumerate(terms, 1))


_SCALE = f"({fn._K0 * fn._RADIUS!r}::DOUBLE)"
_E = 2 * fn._N**0.5 / (1 + fn._N)


@query(f"""WITH {PLACES_SQL}, a AS (SELECT name, sinh(atanh(sin(radians(lat))) - {_E!r}::DOUBLE * atanh({_E!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon - 75e0) AS d FROM places),
b AS (SELECT name, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM a),
p AS (SELECT name, 500000e0 + {_SCALE} * (eta{_series(fn._ALPHA, "+", "cos", "sinh")}) AS x, {_SCALE} * (xi{_series(fn._ALPHA, "+", "sin", "cosh")}) AS y FROM b),
i AS (SELECT *, y / {_SCALE} AS xi, (x - 500000e0) / {_SCALE} AS eta FROM p),
k AS (SELECT *, xi{_series(fn._BETA, "-", "sin", "cosh")} AS v, eta{_series(fn._BETA, "-", "cos", "sinh")} AS u FROM i), c AS (SELECT *, asin(sin(v) / cosh(u)) AS chi FROM k)
SELECT name, round(x, 3) AS x, round(y, 3) AS y, floor((1139177.0464e0 - y) / 30)::INT AS row, floor((x - 628018.1242e0) / 30)::INT AS col, round(75e0 + degrees(atan2(sinh(u), cos(v))), 9) AS lon,
  round(degrees(chi{"".join(f" + ({t!r}::DOUBLE) * sin({2 * j}e0 * chi)" for j, t in enumerate(fn._DELTA, 1))}), 9) AS lat FROM c""")
def places_on_grid(spark, sf_dir):
    """Named places in UTM metres and back, and their cell of the 30 m grid (also tested against the series' own inverse)."""
    x, y = fn.to_utm(F.col("lon"), F.col("lat"))
    placed = places(spark).withColumn("x", x).withColumn("y", y)
    row, col = fn.cell_of(F.col("x"), F.col("y"), (30.0, 0.0, 628018.1242, 0.0, -30.0, 1139177.0464))
    lon, lat = fn.from_utm(F.col("x"), F.col("y"))
    return placed.select("name", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), row.alias("row"), col.alias("col"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(G + "SELECT r, c, flow FROM grid WHERE c BETWEEN 20 AND 60 AND r BETWEEN 10 AND 40")
def box_clip(spark, sf_dir):
    return grid(spark, sf_dir).filter(F.col("c").between(20, 60) & F.col("r").between(10, 40)).select("r", "c", "flow")


RING = [(10.5, 10.5), (70.5, 20.5), (60.5, 80.5), (40.5, 50.5), (15.5, 70.5), (10.5, 10.5)]


@query(G + ", e(x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({a}e0, {b}e0, {c}e0, {d}e0)" for (a, b), (c, d) in zip(RING, RING[1:])) + """),
h AS (SELECT r, c, count(*) FILTER (WHERE (y0 > r) <> (y1 > r) AND c < (x1 - x0) * (r - y0) / (y1 - y0) + x0) AS k FROM grid, e GROUP BY r, c) SELECT r, c FROM h WHERE k % 2 = 1""")
def polygon_clip(spark, sf_dir):
    return grid(spark, sf_dir).filter(align.inside(F.col("c").cast("double"), F.col("r").cast("double"), RING)).select("r", "c")


_LAYERS = [("dem", 1, "new/dem"), ("dem", 2, "old/dem"), ("slope", 2, "old/slope"), ("flow", 1, "new/flow")]
_ROLES = ["dem", "slope", "flow", "hand", "lulc"]


@query("SELECT role FROM (VALUES ('dem'), ('slope'), ('flow'), ('hand'), ('lulc')) AS r(role) WHERE role NOT IN ('dem', 'slope', 'flow')")
def missing_layers(spark, sf_dir):
    return layers.missing(spark.createDataFrame(_LAYERS, "role string, priority int, path string"), spark.createDataFrame([(r,) for r in _ROLES], "role string"))


@query("SELECT * FROM (VALUES ('dem', 1, 'new/dem'), ('slope', 2, 'old/slope'), ('flow', 1, 'new/flow')) AS l(role, priority, path)")
def layer_fallback(spark, sf_dir):
    return layers.resolved(spark.createDataFrame(_LAYERS, "role string, priority int, path string"))


_META = [("flow", "EPSG:32643", "float32"), ("label", "EPSG:32643", "uint8"), ("small", "EPSG:4326", "float32"), ("gone", "EPSG:32643", "int16")]


@query(G + """, l AS (SELECT 'flow' AS layer, r, c, CASE WHEN event_type = 'error' THEN 'nan'::DOUBLE ELSE flow END AS value FROM (SELECT *, CASE WHEN lulc = 80 THEN 'error' END AS event_type FROM grid)
  UNION ALL SELECT 'label', r, c, CASE WHEN lulc = 50 THEN 1e0 ELSE 0e0 END FROM grid UNION ALL SELECT 'small', r, c, dem FROM grid WHERE c < 90),
s AS (SELECT layer, max(r) + 1 AS height, max(c) + 1 AS width, count(value) AS n_valid, count(*) FILTER (WHERE isnan(value)) AS n_nan, min(value) FILTER (WHERE NOT isnan(value)) AS mn, max(value) FILTER (WHERE NOT isnan(value)) AS mx,
  count(*) FILTER (WHERE value = 1) AS ones, count(*) FILTER (WHERE value = 0) AS zeros FROM l GROUP BY layer),
m(layer, crs, dtype) AS (VALUES """ + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _META) + """)
SELECT m.*, s.height, s.width, s.height IS NOT DISTINCT FROM f.height AND s.width IS NOT DISTINCT FROM f.width AS same_shape, crs = 'EPSG:32643' AS same_crs, coalesce(s.n_valid, 0) AS n_valid, coalesce(s.n_nan, 0) AS n_nan, s.mn, s.mx,
  coalesce(s.ones > 0 AND s.zeros > 0 AND s.ones + s.zeros = s.n_valid, false) AS is_binary, CASE WHEN s.ones > 0 AND s.zeros > 0 AND s.ones + s.zeros = s.n_valid THEN s.ones / s.n_valid END AS share_of_ones
FROM m LEFT JOIN s ON m.layer = s.layer, s f WHERE f.layer = 'flow'""")
def layer_check(spark, sf_dir):
    """Shapes, reference systems and values of layers against the first one."""
    g = grid(spark, sf_dir)
    flow = F.when(F.col("lulc") == 80, F.lit(float("nan"))).otherwise(F.col("flow"))
    cells = g.select(F.lit("flow").alias("layer"), "r", "c", flow.alias("value"))
    cells = cells.unionByName(g.select(F.lit("label").alias("layer"), "r", "c", F.when(F.col("lulc") == 50, 1.0).otherwise(0.0).alias("value")))
    cells = cells.unionByName(g.filter("c < 90").select(F.lit("small").alias("layer"), "r", "c", F.col("dem").alias("value")))
    return layers.check(cells, spark.createDataFrame(_META, "layer string, crs string, dtype string"), "flow")


@query("SELECT n_nationkey::INT AS feature, n_name AS name, 0 AS ring, k::INT AS point, n_nationkey + (CASE k WHEN 1 THEN 1e0 WHEN 2 THEN 1e0 ELSE 0e0 END) AS lon, n_regionkey + (CASE WHEN k = 2 THEN 1e0 ELSE 0e0 END) AS lat FROM nation, range(0, 4) AS p(k) WHERE n_name = 'NATION_6'")
def geometry_by_name(spark, sf_dir):
    """The outline of one named place of a feature collection."""
    x, y = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    outline = F.array(F.array(F.array(x, y), F.array(x + 1, y), F.array(x + 1, y + 1), F.array(x, y)))
    f = F.struct(F.create_map(F.lit("name"), F.col("n_name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), outline.alias("coordinates")).alias("geometry"))
    return layers.named(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("feature"), f.alias("f")), "NATION_6")


@query(G + " SELECT band, count(*) AS n, round(sum(value), 6) AS total FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS band, {b} AS value FROM grid" for b in ("flow", "slope", "dem", "ndwi")) + ") WHERE value IS NOT NULL GROUP BY band")
def band_export(spark, sf_dir):
    """What an export of single bands holds."""
    long = tiles.unpivoted(grid(spark, sf_dir), ["flow", "slope", "dem", "ndwi"])
    return long.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(G + ", m AS (SELECT event_id // 100 AS r, event_id % 100 AS c, user_id % 100 / 1e2 AS value FROM events WHERE event_id % 3 <> 0) SELECT r::INT AS r, c::INT AS c, coalesce(m.value, 0) AS channel FROM grid LEFT JOIN m USING (r, c)")
def missing_channel(spark, sf_dir):
    i = F.col("event_id")
    channel = table(spark, sf_dir, "events").filter(i % 3 != 0).select(F.floor(i / 100).cast("int").alias("r"), (i % 100).cast("int").alias("c"), (F.col("user_id") % 100 / 100).alias("value"))
    return grid(spark, sf_dir).select("r", "c").join(channel, ["r", "c"], "left").select("r", "c", F.coalesce("value", F.lit(0.0)).alias("channel"))


_BANDS = ["flow", "slope", "dem", "ndwi"]


@query(G + ", l AS (" + " UNION ALL ".join(f"SELECT '{b}' AS band, {b} AS x FROM grid" for b in _BANDS) + ") SELECT band, count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS n_null, count(*) FILTER (WHERE x = 0) AS n_zero, min(x) AS mn, max(x) AS mx, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM l GROUP BY band")
def raster_profile(spark, sf_dir):
    return stats.profile(grid(spark, sf_dir), _BANDS).withColumn("mean", F.round("mean", 6)).withColumn("var", F.round("var", 6))


@query(G + "SELECT q, round(quantile_cont(flow, q), 9) AS value FROM grid, (VALUES (0.01), (0.02), (0.05), (0.95), (0.98), (0.99)) AS p(q) GROUP BY q".replace("quantile_cont(flow, q)", "CASE q " + " ".join(f"WHEN {q} THEN quantile_cont(flow, {q})" for q in (0.01, 0.02, 0.05, 0.95, 0.98, 0.99)) + " END").replace("SELECT q,", "SELECT q::DOUBLE AS q,"))
def percentiles(spark, sf_dir):
    qs = [0.01, 0.02, 0.05, 0.95, 0.98, 0.99]
    row = ranks.percentile_row(grid(spark, sf_dir), {"flow": F.col("flow")}, {f"p{k}": ("flow", q) for k, q in enumerate(qs)})
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.round(f"p{k}", 9).alias("value")) for k, q in enumerate(qs)]))
    return row.select(each.alias("v")).select("v.*")


@query("SELECT (ts::DATE - DATE '1970-01-01')::INT % 5 AS r, (user_id % 50)::INT AS c, round(quantile_cont(value, 0.5), 9) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1, 2")
def median_composite(spark, sf_dir):
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    dated = table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")).select((day % 5).alias("r"), (F.col("user_id") % 50).cast("int").alias("c"), "value")
    return scenes.median_composite(dated, ["value"]).withColumn("value", F.round("value", 9))


@query("""WITH s AS (SELECT event_id, user_id % 90 / 1e1 AS west, user_id % 70 / 1e1 AS south, ts, event_type AS mode, value AS clouds FROM events)
SELECT event_id FROM s WHERE west <= 4 AND west + 1 >= 2 AND south <= 5 AND south + 1 >= 1 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND mode = 'view' AND clouds < 60""")
def scene_search(spark, sf_dir):
    w, s = F.col("user_id") % 90 / 10, F.col("user_id") % 70 / 10
    found = table(spark, sf_dir, "events").select("event_id", w.alias("west"), s.alias("south"), (w + 1).alias("east"), (s + 1).alias("north"), "ts", F.col("event_type").alias("mode"), F.col("value").alias("clouds"))
    return scenes.search(found, (2.0, 1.0, 4.0, 5.0), "2024-01-05", "2024-01-20", "view", 60.0).select("event_id")


@query("""SELECT strftime(b - to_hours(k * 6), '%Y-%m-%d %H:%M:%S') AS window_start, round(sum(value), 6) AS mm, count(*) AS n
FROM (SELECT value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events), range(0, 4) AS r(k) GROUP BY 1""")
def rainfall_windows(spark, sf_dir):
    found = rainfall.windowed(table(spark, sf_dir, "events").select("ts", "value"))
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.round("mm", 6).alias("mm"), "n")


@query("SELECT n_name AS place, round((24 * n_nationkey + 276) / 1e1, 6) AS mm FROM nation")
def forecast_rainfall(spark, sf_dir):
    hours = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda h: (F.col("n_nationkey") + h) / 10.0)
    made = F.to_json(F.struct(F.struct(hours.alias("precipitation")).alias("hourly")))
    return rainfall.forecast_sum(table(spark, sf_dir, "nation").select(F.col("n_name").alias("place"), made.alias("json"))).withColumn("mm", F.round("mm", 6))


@query(G + "SELECT DISTINCT lulc FROM grid WHERE flow > 50 INTERSECT SELECT DISTINCT lulc FROM grid WHERE slope < 10 EXCEPT SELECT 80")
def cover_sets(spark, sf_dir):
    g = grid(spark, sf_dir)
    both = g.filter("flow > 50").select("lulc").intersect(g.filter("slope < 10").select("lulc"))
    return both.exceptAll(spark.createDataFrame([(80,)], "lulc int"))


@query(G + "SELECT lulc, cover, count(*) AS cells, round(sum(flow), 6) AS flow, grouping(lulc) + grouping(cover) AS level FROM grid GROUP BY ROLLUP (lulc, cover)")
def cover_rollup(spark, sf_dir):
    r = grid(spark, sf_dir).rollup("lulc", "cover").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("flow"), 6).alias("flow"), (F.grouping("lulc") + F.grouping("cover")).cast("long").alias("level"))
    return r.select("lulc", "cover", "cells", "flow", "level")


@query(G + "SELECT r, c, coalesce(dem, -9999) AS dem FROM grid WHERE r BETWEEN 10 AND 25 AND c BETWEEN 30 AND 39")
def block_window(spark, sf_dir):
    """A clipped block, as a sink with a sentinel would hold it."""
    return grid(spark, sf_dir).filter(F.col("r").between(10, 25) & F.col("c").between(30, 39)).select("r", "c", tiles.with_sentinel(F.col("dem")).alias("dem"))
