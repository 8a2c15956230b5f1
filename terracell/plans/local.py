"""Queries of single cells: nodata, normalisation, terrain indices, masks, palettes, small dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions import columns as fn
from terracell.operators import ranks, stats
from terracell.sources.grid import GRID_SQL, PLACES_SQL, grid, places, table

from .catalog import query

G = f"WITH {GRID_SQL} "


@query(G + """SELECT r, c, CASE WHEN NOT (flow < 5e0) THEN flow END AS below, CASE WHEN lulc > 10 THEN lulc END AS codes, CASE WHEN ndwi <> 0e0 THEN ndwi END AS sentinel,
  CASE WHEN flow <= 1.5e0 * (SELECT quantile_cont(flow, 0.99) FROM grid) THEN flow END AS outlier FROM grid""")
def nodata_rules(spark, sf_dir):
    cells = ranks.with_percentiles(grid(spark, sf_dir), _p=(F.col("flow"), 0.99))
    f = F.col("flow")
    return cells.select("r", "c", fn.to_null(f, below=5.0).alias("below"), F.when(F.col("lulc") > 10, F.col("lulc")).alias("codes"), fn.to_null(F.col("ndwi"), equals=0.0).alias("sentinel"), F.when(f <= 1.5 * F.col("_p"), f).alias("outlier"))


@query(G + """, s AS (SELECT min(dem) a, max(dem) b, min(CASE WHEN ndwi <> 0 THEN ndwi END) na, max(CASE WHEN ndwi <> 0 THEN ndwi END) nb FROM grid)
SELECT r, c, round((dem - a) / (b - a + 1e-6), 9) AS plain, round((dem - a) / (b - a), 9) AS exact, round((ndwi - na) / (nb - na), 9) AS nonzero, round(lulc / 255e0, 9) AS categorical,
  round(CASE WHEN slope IS NOT NULL THEN least(greatest((slope - 10e0) / (80e0 - 10e0 + 1e-6), 0), 1) END, 9) AS stored, CASE WHEN flow > 50 THEN 1 ELSE 0 END AS label FROM grid, s""")
def normalise_minmax(spark, sf_dir):
    cells = stats.minmax_or_zero(stats.minmax(grid(spark, sf_dir), "dem", "plain"), "dem", "exact")
    known = spark.createDataFrame([("slope", 10.0, 80.0)], "band string, mn double, mx double")
    cells = stats.stored_range(stats.minmax_of_nonzero(cells, "ndwi", "nonzero"), known, "slope", "stored")
    rounded = [F.round(x, 9).alias(x) for x in ("plain", "exact", "nonzero", "stored")]
    return cells.select("r", "c", *rounded, F.round(F.col("lulc") / 255, 9).alias("categorical"), F.when(F.col("flow") > 50, 1).otherwise(0).alias("label"))


@query(G + """, s AS (SELECT quantile_cont(flow, 0.01) fa, quantile_cont(flow, 0.99) fb, quantile_cont(dem, 0.01) da, quantile_cont(dem, 0.99) db FROM grid)
SELECT r, c, round(least(greatest((flow - fa) / greatest(fb - fa, 1e-6), 0), 1), 9) AS flow_n, round(CASE WHEN dem IS NULL THEN 0 ELSE least(greatest((dem - da) / greatest(db - da, 1e-6), 0), 1) END, 9) AS dem_n FROM grid, s""")
def normalise_robust(spark, sf_dir):
    cells = stats.robust_bands(grid(spark, sf_dir), {"flow": "flow_n", "dem": "dem_n"})
    return cells.select("r", "c", F.round("flow_n", 9).alias("flow_n"), F.round("dem_n", 9).alias("dem_n"))


@query(G + """, t AS (SELECT *, avg(flow) OVER (PARTITION BY r // 64, c // 64) AS m FROM grid WHERE dem IS NOT NULL),
u AS (SELECT r, c, CASE WHEN m < 15 THEN exp(flow) ELSE flow END * 30e0 AS sca, radians(greatest(slope, 0.1e0)) AS s FROM t)
SELECT r, c, round(CASE WHEN sca > 0 THEN ln(sca / (tan(s) + 1e-6)) END, 6) AS twi, round(ln(1 + sca * tan(s)), 6) AS spi, round(ln(1 + pow(sca / 22.13e0, 0.6e0) * pow(sin(s) / 0.0896e0, 1.3e0)), 6) AS sti FROM u""")
def terrain_indices(spark, sf_dir):
    from pyspark.sql import Window

    tile = Window.partitionBy(F.floor(F.col("r") / 64), F.floor(F.col("c") / 64))
    cells = grid(spark, sf_dir).filter("dem IS NOT NULL").withColumn("_m", F.avg("flow").over(tile))
    area, rad = fn.contributing_area(F.col("flow"), F.col("_m")), fn.slope_radians(F.col("slope"))
    return cells.select("r", "c", F.round(fn.wetness(area, rad), 6).alias("twi"), F.round(fn.stream_power(area, rad), 6).alias("spi"), F.round(fn.sediment_transport(area, rad), 6).alias("sti"))


@query(G + """, s AS (SELECT avg(flow) m, quantile_cont(flow, 0.95) q FROM grid)
SELECT r, c, (lulc IN (80, 90, 95) OR dem IS NULL OR dem < 0.5) AS water, lulc = 50 AS urban, CASE WHEN m < 15 THEN exp(flow) ELSE flow END > 1000 / 30e0 AS drainage, flow >= q AS channel,
  (cover > 0 AND cover < 100) AS land FROM grid, s""")
def surface_masks(spark, sf_dir):
    f = F.col("flow")
    cells = stats.with_stats(ranks.with_percentiles(grid(spark, sf_dir), _q=(f, 0.95)), _m=F.avg(f))
    drained = F.when(F.col("_m") < 15, F.exp(f)).otherwise(f) > 1000 / 30
    return cells.select("r", "c", fn.water_mask(F.col("lulc"), F.col("dem")).alias("water"), (F.col("lulc") == 50).alias("urban"), drained.alias("drainage"), (f >= F.col("_q")).alias("channel"), ((F.col("cover") > 0) & (F.col("cover") < 100)).alias("land"))


@query(G + "SELECT r, c, CASE WHEN flow + dem <> 0 THEN (flow - dem) / (flow + dem) END AS ndwi, CASE WHEN slope + flow <> 0 THEN (slope - flow) / (slope + flow) END AS ndvi FROM grid")
def spectral_indices(spark, sf_dir):
    f, d, s = F.col("flow"), F.col("dem"), F.col("slope")
    return grid(spark, sf_dir).select("r", "c", fn.difference_index(f, d).alias("ndwi"), fn.difference_index(s, f).alias("ndvi"))


_LADDER = lambda x, steps, op: "CASE WHEN " + x + " IS NULL THEN NULL " + " ".join(f"WHEN {x} {op} {b}e0 THEN '{n}'" for n, b in reversed(steps[1:])) + f" ELSE '{steps[0][0]}' END"


@query(G + "SELECT r, c, " + ", ".join(f"{_LADDER('p150', s, '>=')} AS {n}" for n, s in fn.LADDERS.items()) + f", {_LADDER('p150', fn.STRICT_LADDERS['hotspot'], '>')} AS hotspot FROM grid")
def risk_ladders(spark, sf_dir):
    return grid(spark, sf_dir).select("r", "c", *[fn.ladder(F.col("p150"), n).alias(n) for n in [*fn.LADDERS, *fn.STRICT_LADDERS]])


def _colour(k: int) -> str:
    steps = reversed(list(zip(fn.KNOTS, fn.KNOTS[1:])))
    return "CASE WHEN NOT inside THEN 0 " + " ".join(f"WHEN p >= {a}e0 THEN floor({ca[k]} * (1 - (p - {a}e0) / ({b}e0 - {a}e0 + 1e-6)) + {cb[k]} * ((p - {a}e0) / ({b}e0 - {a}e0 + 1e-6)))::INT" for (a, ca), (b, cb) in steps) + " END"


@query(G + f", x AS (SELECT r AS row, c AS col, p200 AS p, p200 BETWEEN 0 AND 1 AS inside FROM grid) SELECT row, col, {_colour(0)} AS r, {_colour(1)} AS g, {_colour(2)} AS b, CASE WHEN inside THEN 200 ELSE 0 END AS a FROM x")
def probability_colours(spark, sf_dir):
    return grid(spark, sf_dir).select(F.col("r").alias("row"), F.col("c").alias("col"), *fn.colormap(F.col("p200")))


@query(G + """, s AS (SELECT quantile_cont(slope, 0.02) a, quantile_cont(slope, 0.98) b, max(abs(ndwi)) m, min(ln(1 + greatest(flow, 0))) fa, max(ln(1 + greatest(flow, 0))) fb FROM grid)
SELECT r, c, round(least(greatest((slope - a) / (b - a + 1e-6), 0), 1), 9) AS slope_s, round(least(greatest((ndwi + m) / (2 * m + 1e-6), 0), 1), 9) AS symmetric,
  round(least(greatest(dist_built / 2000e0, 0), 1), 9) AS fixed, round((ln(1 + greatest(flow, 0)) - fa) / (fb - fa + 1e-6), 9) AS logged FROM grid, s""")
def layer_stretches(spark, sf_dir):
    slope, ndwi, log = F.col("slope"), F.col("ndwi"), fn.log_flow(F.col("flow"))
    s = stats.with_stats(ranks.with_percentiles(grid(spark, sf_dir), _a=(slope, 0.02), _b=(slope, 0.98)), _m=F.max(F.abs(ndwi)), _fa=F.min(log), _fb=F.max(log))
    return s.select(
        "r", "c", F.round(fn.clip((slope - F.col("_a")) / (F.col("_b") - F.col("_a") + 1e-6), 0.0, 1.0), 9).alias("slope_s"), F.round(fn.clip((ndwi + F.col("_m")) / (2 * F.col("_m") + 1e-6), 0.0, 1.0), 9).alias("symmetric"),
        F.round(fn.clip(F.col("dist_built") / 2000, 0.0, 1.0), 9).alias("fixed"), F.round((log - F.col("_fa")) / (F.col("_fb") - F.col("_fa") + 1e-6), 9).alias("logged"),
    )


@query(f"WITH {PLACES_SQL} SELECT 'ka' AS q, name, lat, lon FROM places WHERE contains(lower(name), 'ka') ORDER BY ordinal LIMIT 1")
def place_search(spark, sf_dir):
    asked = " KA ".strip().lower()
    return places(spark).filter(F.contains(F.lower("name"), F.lit(asked))).orderBy("ordinal").limit(1).select(F.lit(asked).alias("q"), "name", "lat", "lon")


@query("SELECT event_id, CASE WHEN value * 3 <= 125 THEN 100 WHEN value * 3 <= 175 THEN 150 ELSE 200 END AS scenario, value * 3 >= 200 AS banner FROM events")
def scenario_snap(spark, sf_dir):
    mm = F.col("value") * 3
    return table(spark, sf_dir, "events").select("event_id", fn.nearest_scenario(mm).alias("scenario"), (mm >= 200).alias("banner"))


#: Land-cover classes of the short table, with colours.
COVER = [(1, "Trees", 34, 139, 34), (2, "Shrubs", 154, 205, 50), (4, "Crops", 240, 200, 80), (5, "Built-up", 220, 20, 60), (8, "Water", 30, 100, 220)]


@query(G + ", d(cover, name, red, green, blue) AS (VALUES " + ", ".join(map(str, COVER)) + ") SELECT r, c, name, red, green, blue FROM grid LEFT JOIN d USING (cover)")
def cover_palette(spark, sf_dir):
    legend = spark.createDataFrame(COVER, "cover int, name string, red int, green int, blue int")
    return grid(spark, sf_dir).join(F.broadcast(legend), "cover", "left").select("r", "c", "name", "red", "green", "blue")
