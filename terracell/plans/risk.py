"""Queries of the risk layers and of what is served from them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terracell.functions import columns as fn
from terracell.operators import risk, stats
from terracell.sources.grid import GRID_SQL, grid

from .catalog import query

MCDA_SQL = GRID_SQL + """, p AS (SELECT quantile_cont(ln(1 + flow), 0.99) AS p99 FROM grid WHERE flow > 0),
mcda AS (SELECT grid.*, 0.35e0 * least(greatest(ln(1 + greatest(coalesce(flow, 0), 0)) / (p99 + 1e-6), 0), 1) + 0.25e0 * least(greatest(1 - coalesce(slope, 90) / 90e0, 0), 1)
  + 0.2e0 * least(greatest((coalesce(ndwi, -1) + 1) / 2e0, 0), 1) + 0.2e0 * least(greatest(1 - coalesce(dist_built, 5000) / 2000e0, 0), 1) AS base_risk FROM grid, p)"""
SCEN_SQL = MCDA_SQL + """, scen AS (SELECT mcda.*, mm AS scenario_mm, CASE WHEN dem IS NOT NULL AND cover > 0 AND cover < 100 THEN least(greatest(base_risk * factor, 0), 1) END AS prob
  FROM mcda, (VALUES (100, 0.8e0), (150, 1.6e0), (200, 2.6e0)) AS s(mm, factor))"""


def _land():
    return F.col("dem").isNotNull() & (F.col("cover") > 0) & (F.col("cover") < 100)


def scenario_cells(spark, sf_dir, *wanted: int):
    """All scenarios, or the wanted ones alone."""
    factors = {mm: f for mm, f in risk.SCENARIO_FACTORS.items() if not wanted or mm in wanted}
    return risk.scenarios(risk.multi_criteria(grid(spark, sf_dir)), _land(), factors)


@query(f"WITH {MCDA_SQL} SELECT r, c, round(base_risk, 9) AS base_risk FROM mcda")
def multi_criteria_risk(spark, sf_dir):
    return risk.multi_criteria(grid(spark, sf_dir)).select("r", "c", F.round("base_risk", 9).alias("base_risk"))


@query(f"WITH {SCEN_SQL} SELECT r, c, scenario_mm, round(prob, 9) AS prob FROM scen")
def scenario_risk(spark, sf_dir):
    return scenario_cells(spark, sf_dir).select("r", "c", "scenario_mm", F.round("prob", 9).alias("prob"))


_STATS = """count(*) AS n, round(100e0 * avg(CASE WHEN prob < 0.1 THEN 1e0 ELSE 0e0 END), 2) AS safe, round(100e0 * avg(CASE WHEN prob >= 0.1 AND prob < 0.25 THEN 1e0 ELSE 0e0 END), 2) AS moderate,
  round(100e0 * avg(CASE WHEN prob >= 0.25 AND prob < 0.5 THEN 1e0 ELSE 0e0 END), 2) AS high, round(100e0 * avg(CASE WHEN prob >= 0.5 THEN 1e0 ELSE 0e0 END), 2) AS critical, round(avg(prob), 4) AS mean_prob, round(max(prob), 4) AS max_prob"""


def _served(mm: int):
    def run(spark, sf_dir):
        return risk.risk_stats(scenario_cells(spark, sf_dir, mm))

    run.__name__ = f"risk_stats_{mm}"
    query(f"WITH {SCEN_SQL} SELECT {_STATS} FROM scen WHERE scenario_mm = {mm} AND prob >= 0")(run)


for _mm in (100, 150, 200):
    _served(_mm)


@query(f"WITH {SCEN_SQL} SELECT scenario_mm, max(prob) AS max_prob, round(avg(prob), 9) AS mean_prob, count(prob) > 0 AS available FROM scen GROUP BY scenario_mm")
def scenario_availability(spark, sf_dir):
    return scenario_cells(spark, sf_dir).groupBy("scenario_mm").agg(F.max("prob").alias("max_prob"), F.round(F.avg("prob"), 9).alias("mean_prob"), (F.count("prob") > 0).alias("available"))


HYDRO_SQL = GRID_SQL + """, h AS (SELECT *, ln(1 + greatest(flow, 0)) AS lf, dist_built / 250e0 AS hand, ln(flow * 30e0 / (tan(radians(greatest(slope, 0.1e0))) + 1e-6)) AS twi FROM grid),
s AS (SELECT min(lf) f0, max(lf) f1, min(slope) s0, max(slope) s1, min(twi) t0, max(twi) t1 FROM h),
hyd AS (SELECT h.*, least(greatest(0.85e0 * (0.75e0 * (0.7e0 * ((lf - f0) / (f1 - f0 + 1e-6)) + 0.3e0 * (1 - (slope - s0) / (s1 - s0 + 1e-6))) + 0.25e0 * (1 - least(greatest(hand, 0), 20) / 20e0))
  + 0.15e0 * least(greatest((twi - t0) / (t1 - t0 + 1e-6), 0), 1), 0), 1) AS hydro FROM h, s)"""
AT_SQL = """(CASE WHEN p IS NULL THEN NULL ELSE least(greatest(greatest(least(greatest(p + hydro * least({mm}e0 / 200, 1) * 0.2e0, 0), 1), hydro * ({mm}e0 / 200) * 1.2e0), 0), 1) END)"""


def hydro_cells(spark, sf_dir):
    """The grid with `hydro`.  Wetness without flow is minus infinity, as a logarithm of floating-point numbers has it;
    there, unknown slope counts as the least."""
    cells = grid(spark, sf_dir).withColumn("hand", F.col("dist_built") / 250)
    return risk.hydro_composite(cells.withColumn("twi", fn.wetness(F.col("flow") * 30, fn.slope_radians(F.coalesce("slope", F.lit(0.1))), dry=-math.inf)))


@query(f"WITH {HYDRO_SQL} SELECT r, c, round(hydro, 9) AS hydro FROM hyd")
def hydro_composite(spark, sf_dir):
    return hydro_cells(spark, sf_dir).select("r", "c", F.round("hydro", 9).alias("hydro"))


_P = {125: "p100 * (1 - 25 / 50e0) + p150 * (25 / 50e0)", 60: "p100 * 60e0 / 100", 180: "p150 * (1 - 30 / 50e0) + p200 * (30 / 50e0)", 400: "p150 * (1 - 50 / 50e0) + p200 * (50 / 50e0)"}


@query(f"WITH {HYDRO_SQL} " + " UNION ALL ".join(f"SELECT {mm} AS mm, r, c, round({AT_SQL.format(mm=mm)}, 9) AS prob FROM (SELECT r, c, hydro, {p} AS p FROM hyd)" for mm, p in _P.items()))
def risk_at_rainfall(spark, sf_dir):
    each = hydro_cells(spark, sf_dir).withColumn("mm", F.explode(F.array(*[F.lit(mm) for mm in _P])))
    return risk.at_rainfall(each, F.col("mm")).select("mm", "r", "c", F.round("prob", 9).alias("prob"))


_BOOSTED = "least(greatest(p + hydro * least({mm}e0 / 200, 1) * 0.2e0, 0), 1)"


@query(f"""WITH {HYDRO_SQL} SELECT 'raw' AS view, r, c, round({_BOOSTED.format(mm=180)}, 9) AS prob FROM (SELECT r, c, hydro, {_P[180]} AS p FROM hyd)
UNION ALL SELECT 'physics' AS view, r, c, round(least(greatest(coalesce(hydro, 0) * (180e0 / 200) * 1.2e0, 0), 1), 9) AS prob FROM hyd""")
def risk_views(spark, sf_dir):
    """What the maps say alone, and what the terrain says alone, at 180 mm."""
    cells = hydro_cells(spark, sf_dir)  # once; each view is a column of it
    probs = [F.struct(F.lit(v).alias("view"), F.round(risk.view_of(F.lit(180.0), v), 9).alias("prob")) for v in ("raw", "physics")]
    return cells.select("r", "c", F.explode(F.array(*probs)).alias("v")).select("v.view", "r", "c", "v.prob")


@query(f"""WITH {HYDRO_SQL}, a AS (SELECT {AT_SQL.format(mm=150)} AS prob FROM (SELECT r, c, hydro, p150 AS p FROM hyd)),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE prob >= 0.45) AS critical_cells, count(*) FILTER (WHERE prob >= 0.25) AS high_cells FROM a WHERE prob IS NOT NULL),
k AS (SELECT *, 100e0 * critical_cells / n AS critical_pct, 100e0 * high_cells / n AS high_pct, critical_cells * (3068e0 / n) AS critical_km2 FROM n)
SELECT *, least(trunc(critical_km2 * 1068e0 * 0.18e0)::BIGINT, 3500000) AS people, greatest(1, least(trunc(critical_pct / 8)::INT, 6)) AS hospitals, critical_km2 * 50e0 AS loss_crore, critical_km2 * 50e0 * 0.12e0 AS loss_usd_m,
  CASE WHEN critical_pct > 15 THEN 'CRITICAL' WHEN high_pct > 25 THEN 'WARNING' ELSE 'MONITORING' END AS level FROM k""")
def risk_alert(spark, sf_dir):
    return risk.alert(risk.at_rainfall(hydro_cells(spark, sf_dir), 150))


@query(f"""WITH {HYDRO_SQL}, i AS (SELECT mm::DOUBLE AS mm, CASE WHEN p IS NULL THEN NULL ELSE least(greatest(greatest(p, hydro * (mm / 200e0) * 1.2e0), 0), 1) END AS prob FROM (
  SELECT hyd.*, mm, CASE WHEN mm <= 100 THEN p100 * mm / 100e0 WHEN mm <= 150 THEN p100 * (1 - (mm - 100) / 50e0) + p150 * ((mm - 100) / 50e0) ELSE p150 * (1 - (mm - 150) / 50e0) + p200 * ((mm - 150) / 50e0) END AS p
  FROM hyd, (VALUES (50), (100), (150), (200)) AS s(mm)))
SELECT mm, 100e0 * count(*) FILTER (WHERE prob >= 0.3) / count(prob) AS critical_pct, 100e0 * count(*) FILTER (WHERE prob >= 0.2) / count(prob) AS high_pct FROM i GROUP BY mm""")
def rainfall_comparison(spark, sf_dir):
    return risk.compare_rainfalls(hydro_cells(spark, sf_dir))


@query(f"""WITH {HYDRO_SQL}, a AS (SELECT {AT_SQL.format(mm=180)} AS prob FROM (SELECT hydro, {_P[180]} AS p FROM hyd)),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE prob >= 0.3) AS zone_cells FROM a WHERE prob IS NOT NULL)
SELECT n, zone_cells, 100e0 * zone_cells / n AS zone_pct, CASE WHEN 100e0 * zone_cells / n > 20 THEN 'CRITICAL' WHEN 100e0 * zone_cells / n > 10 THEN 'WARNING' ELSE 'NORMAL' END AS level, 'immediate' AS action FROM n""")
def evacuation_zone(spark, sf_dir):
    return risk.evacuation(risk.at_rainfall(hydro_cells(spark, sf_dir), 180), 180)


@query(f"WITH {SCEN_SQL} SELECT cover, count(*) AS cells, count(*) * 0.0009e0 AS km2 FROM scen WHERE scenario_mm = 100 AND prob > 0.25 AND cover > 0 GROUP BY cover HAVING count(*) * 0.0009e0 > 0.1e0")
def risk_by_cover(spark, sf_dir):
    return risk.by_cover(scenario_cells(spark, sf_dir, 100))


@query(f"""WITH {SCEN_SQL}, s AS (SELECT min(prob) a, max(prob) b FROM scen WHERE scenario_mm = 100), x AS (SELECT prob, (b - a) / 50 AS w, a FROM scen, s WHERE scenario_mm = 100 AND prob IS NOT NULL),
y AS (SELECT least(floor((prob - a) / w), 49)::INT AS bin, a, w FROM x) SELECT bin, round(a + bin * w, 9) AS lo, round(a + (bin + 1) * w, 9) AS hi, count(*) AS n FROM y GROUP BY bin, a, w""")
def risk_histogram(spark, sf_dir):
    h = stats.histogram(scenario_cells(spark, sf_dir, 100), "prob")
    return h.select("bin", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n")


@query(f"""WITH {SCEN_SQL} SELECT r, c, 628018.1242e0 + 30e0 * c AS x, 1139177.0464e0 - 30e0 * r AS y, round(prob, 6) AS prob, CASE WHEN prob >= 0.3 THEN 'Critical' WHEN prob >= 0.2 THEN 'High' WHEN prob >= 0.1 THEN 'Moderate' ELSE 'Safe' END AS level
FROM scen WHERE scenario_mm = 100 AND prob IS NOT NULL ORDER BY md5('7|' || r || '|' || c), r, c LIMIT 1000""")
def sampled_points(spark, sf_dir):
    """A uniform sample of cells for export, by the hash of their place: the same one at each run."""
    x, y = fn.corner_of(F.col("r"), F.col("c"), (30.0, 0.0, 628018.1242, 0.0, -30.0, 1139177.0464))
    cells = scenario_cells(spark, sf_dir, 100).filter("prob IS NOT NULL")
    chosen = cells.orderBy(F.md5(F.concat_ws("|", F.lit("7"), "r", "c")), "r", "c").limit(1000)
    return chosen.select("r", "c", x.alias("x"), y.alias("y"), F.round("prob", 6).alias("prob"), fn.ladder(F.col("prob"), "csv").alias("level"))


@query(f"WITH {SCEN_SQL}, n AS (SELECT max(CASE WHEN scenario_mm = 100 THEN prob END) AS p100, max(CASE WHEN scenario_mm = 200 THEN prob END) AS p200, r, c FROM scen GROUP BY r, c) SELECT r, c, round(p100 * 0.4e0 + p200 * 0.6e0, 9) AS mixed FROM n")
def scenario_pivot(spark, sf_dir):
    """Long scenarios to wide bands, then a mix of two of them."""
    wide = scenario_cells(spark, sf_dir, 100, 200).groupBy("r", "c").pivot("scenario_mm", [100, 200]).agg(F.max("prob"))
    return wide.select("r", "c", F.round(F.col("100") * 0.4 + F.col("200") * 0.6, 9).alias("mixed"))
