"""Queries whose states also serve streams: merged metrics, rainfall to risk, forecasts to risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions import columns as fn
from terracell.operators import align, metric_state
from terracell.sources.grid import table
from terracell.streaming import rainfall

from .catalog import query
from .relational import POINTS_SQL, _points
from .risk import HYDRO_SQL, hydro_cells

BINS = 200
_SCORED = "sc AS (SELECT n_chars / (SELECT max(n_chars) + 1 FROM documents)::DOUBLE AS pred, quality::DOUBLE AS target FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL)"


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    top = F.broadcast(docs.agg((F.max("n_chars") + 1).cast("double").alias("_top")))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").crossJoin(top).select("doc_id", (F.col("n_chars") / F.col("_top")).alias("pred"), F.col("quality").cast("double").alias("target"))


def _parts(spark, sf_dir):
    """The state of three parts of the rows, merged."""
    scored = _scored(spark, sf_dir)
    return metric_state.merge(*[metric_state.update(scored.filter(F.pmod("doc_id", F.lit(3)) == k), BINS, 0.1) for k in range(3)])


@query(f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (WHERE pred >= 0.1e0 AND target > 0.5) AS tp, count(*) FILTER (WHERE pred >= 0.1e0 AND target <= 0.5) AS fp, count(*) FILTER (WHERE pred < 0.1e0 AND target > 0.5) AS fn, count(*) FILTER (WHERE pred < 0.1e0 AND target <= 0.5) AS tn FROM sc),
b AS (SELECT floor(pred * {BINS})::INT AS bin, count(*) FILTER (WHERE target > 0.5) AS t, count(*) FILTER (WHERE target <= 0.5) AS f FROM sc GROUP BY 1),
k AS (SELECT *, sum(t) OVER (ORDER BY bin DESC) AS tp, sum(f) OVER (ORDER BY bin DESC) AS fp, sum(t) OVER () AS p, sum(f) OVER () AS n FROM b),
a AS (SELECT sum(f * (2 * tp - t)) / 2e0 / max(p * n) AS auc, sum(t * f) / 2e0 / max(p * n) AS auc_error, sum(t * tp / (tp + fp)::DOUBLE) / max(p) AS ap FROM k)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp + fn, 0)::DOUBLE, 9) AS iou, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 9) AS dice, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS prec, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall,
  round(auc, 9) AS auc, round(auc_error, 9) AS auc_error, round(ap, 9) AS ap FROM c, a""")
def merged_metrics(spark, sf_dir):
    """Metrics finished from merged states of parts: counts exact, areas from bins with their bound."""
    rounded = lambda names: [F.round(n, 9).alias(n) for n in names]
    return metric_state.finish(_parts(spark, sf_dir)).select("tp", "fp", "fn", "tn", *rounded(["iou", "dice", "prec", "recall", "auc", "auc_error", "ap"]))


@query(f"WITH {_SCORED} SELECT floor(pred * 10)::INT AS bin, count(*) AS n, round(avg(pred), 9) AS mean_pred, round(avg(target), 9) AS mean_target FROM sc WHERE pred >= 0 AND pred < 1 GROUP BY 1")
def merged_calibration(spark, sf_dir):
    """Ten calibration groups from the same merged state."""
    return metric_state.calibration(_parts(spark, sf_dir), BINS).select("bin", "n", F.round("mean_pred", 9).alias("mean_pred"), F.round("mean_target", 9).alias("mean_target"))


_WINDOWS = """SELECT b - to_hours(k * 6) AS window_start, sum(value) * 0.01e0 AS mm FROM (SELECT value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events), range(0, 4) AS r(k) GROUP BY 1"""
_MAPPED = "CASE WHEN least(greatest({mm}, 0), 200) <= 100 THEN p100 * least(greatest({mm}, 0), 200) / 100 WHEN least(greatest({mm}, 0), 200) <= 150 THEN p100 * (1 - (least({mm}, 200) - 100) / 50) + p150 * (least({mm}, 200) - 100) / 50 ELSE p150 * (1 - (least({mm}, 200) - 150) / 50) + p200 * (least({mm}, 200) - 150) / 50 END"


def _risk_sql(mm: str) -> str:
    boosted = f"least(greatest(({_MAPPED.format(mm=mm)}) + hydro * least({mm} / 200, 1) * 0.2e0, 0), 1)"
    return f"least(greatest(greatest({boosted}, hydro * ({mm} / 200) * 1.2e0), 0), 1)"


@query(f"""WITH {HYDRO_SQL}, w AS ({_WINDOWS}), x AS (SELECT window_start, mm, {_risk_sql('mm')} AS risk FROM hyd, w)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, round(mm, 6) AS mm, count(risk) AS n_cells, round(avg(risk), 6) AS mean_risk, count(*) FILTER (WHERE risk >= 0.45) AS critical, count(*) FILTER (WHERE risk >= 0.25) AS high FROM x GROUP BY ALL""")
def rainfall_risk(spark, sf_dir):
    """Risk of the whole grid in each rainfall window: the batch twin of streaming.rainfall.start_risk."""
    cells = hydro_cells(spark, sf_dir).select(F.col("p100").alias("m100"), F.col("p150").alias("m150"), F.col("p200").alias("m200"), "hydro")
    found = rainfall.risk_by_window(rainfall.windowed(table(spark, sf_dir, "events").select("ts", "value")), cells, 0.01)
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.round("mm", 6).alias("mm"), "n_cells", F.round("mean_risk", 6).alias("mean_risk"), "critical", "high")


@query(f"""WITH {HYDRO_SQL}, {POINTS_SQL}, f AS (SELECT n_name AS name, (24 * n_nationkey + 276) / 1e1 AS mm FROM nation)
SELECT pts.name, f.mm, round({_risk_sql('f.mm')}, 9) AS risk, CASE WHEN {_risk_sql('f.mm')} IS NULL THEN NULL WHEN {_risk_sql('f.mm')} >= 0.3 THEN 'Critical' WHEN {_risk_sql('f.mm')} >= 0.2 THEN 'High' WHEN {_risk_sql('f.mm')} >= 0.12 THEN 'Moderate' ELSE 'Safe' END AS level
FROM pts JOIN f ON pts.name = f.name LEFT JOIN hyd ON hyd.r = pts.r AND hyd.c = pts.c""")
def forecast_risk(spark, sf_dir):
    """The next day's forecast sum of each place, and the risk of the place's cell at that rainfall."""
    hours = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda h: (F.col("n_nationkey") + h) / 10.0)
    made = table(spark, sf_dir, "nation").select(F.col("n_name").alias("place"), F.to_json(F.struct(F.struct(hours.alias("precipitation")).alias("hourly"))).alias("json"))
    forecast = rainfall.forecast_sum(made).withColumnRenamed("place", "name")
    at = align.lookup(_points(spark, sf_dir), hydro_cells(spark, sf_dir), ["p100", "p150", "p200", "hydro"]).join(forecast, "name")
    mapped = fn.hydro_boost(fn.rainfall_interpolation(F.col("mm"), F.col("p100"), F.col("p150"), F.col("p200")), F.col("hydro"), F.col("mm"))
    risk = at.withColumn("risk", fn.hybrid_risk(mapped, F.col("hydro"), F.col("mm")))
    return risk.select("name", F.round("mm", 6).alias("mm"), F.round("risk", 9).alias("risk"), fn.ladder(F.col("risk"), "dashboard").alias("level"))
