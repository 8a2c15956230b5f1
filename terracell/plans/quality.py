"""Queries of classification quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.operators import metrics
from terracell.sources.grid import table

from .catalog import query

S = """WITH m AS (SELECT max(n_chars) + 1 AS m FROM documents), scored AS (SELECT n_chars / m::DOUBLE AS pred, quality::DOUBLE AS target FROM documents JOIN labels USING (doc_id), m),
cm AS (SELECT count(*) FILTER (WHERE pred >= 0.05 AND target > 0.5) AS tp, count(*) FILTER (WHERE pred >= 0.05 AND target <= 0.5) AS fp, count(*) FILTER (WHERE pred < 0.05 AND target > 0.5) AS fn, count(*) FILTER (WHERE pred < 0.05 AND target <= 0.5) AS tn FROM scored),
b AS (SELECT pred AS score, sum(CASE WHEN target > 0.5 THEN 1 ELSE 0 END) AS t, sum(CASE WHEN target > 0.5 THEN 0 ELSE 1 END) AS f FROM scored GROUP BY 1),
cu AS (SELECT score, sum(t) OVER w AS tp, sum(f) OVER w AS fp, sum(t) OVER () AS p, sum(f) OVER () AS n FROM b WINDOW w AS (ORDER BY score DESC)) """
_RATES = """tp / (tp + fp + fn)::DOUBLE AS iou, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS dice, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS prec, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END AS specificity, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy"""
_AREAS = """SELECT (SELECT sum((fp - fp0) * (tp + tp0)) / 2e0 / max(p * n) FROM (SELECT *, coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS tp0, coalesce(lag(fp) OVER (ORDER BY score DESC), 0) AS fp0 FROM cu)) AS auc,
(SELECT sum((tp - tp0) * tp / (tp + fp)::DOUBLE) / max(p) FROM (SELECT *, coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS tp0 FROM cu)) AS ap"""


def scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    most = F.broadcast(docs.agg((F.max("n_chars") + 1).alias("m")))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").crossJoin(most).select((F.col("n_chars") / F.col("m")).alias("pred"), F.col("quality").cast("double").alias("target"))


@query(S + f"SELECT tp, fp, fn, tn, {_RATES} FROM cm")
def confusion_rates(spark, sf_dir):
    return metrics.rates(metrics.confusion(scored(spark, sf_dir), 0.05))


@query(S + "SELECT score, fp / n::DOUBLE AS fpr, tp / p::DOUBLE AS tpr FROM cu")
def roc_curve(spark, sf_dir):
    return metrics.roc_points(scored(spark, sf_dir))


@query(S + "SELECT score, tp / (tp + fp)::DOUBLE AS prec, tp / p::DOUBLE AS recall FROM cu")
def precision_recall_curve(spark, sf_dir):
    return metrics.pr_points(scored(spark, sf_dir))


@query(S + f"SELECT round(auc, 9) AS auc, round(ap, 9) AS ap FROM ({_AREAS})")
def curve_areas(spark, sf_dir):
    return metrics.areas(scored(spark, sf_dir)).select(F.round("auc", 9).alias("auc"), F.round("ap", 9).alias("ap"))


@query(S + "SELECT floor(pred * 10)::INT AS bin, count(*) AS n, round(avg(pred), 9) AS mean_pred, round(avg(target), 9) AS mean_target FROM scored WHERE pred >= 0 AND pred < 1 GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return metrics.calibration(scored(spark, sf_dir)).select("bin", "n", F.round("mean_pred", 9).alias("mean_pred"), F.round("mean_target", 9).alias("mean_target"))


@query(S + f", w AS (SELECT *, {_RATES} FROM cm), a AS ({_AREAS}) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}, 9) AS value FROM w, a" for m in ("iou", "dice", "prec", "recall", "f1", "specificity", "accuracy", "auc", "ap")))
def quality_report(spark, sf_dir):
    return metrics.report(scored(spark, sf_dir), 0.05).withColumn("value", F.round("value", 9))


#: Published scores of the compared models and of the ablation.
MODELS = [("attention", 0.712, 0.632, 100_000, 900_000), ("standard", 0.648, 0.573, 100_000, 900_000), ("cnn", 0.612, 0.521, 100_000, 900_000), ("forest", 1.0, 0.095, 100_000, 900_000), ("linear", 0.0, 0.0, 100_000, 900_000)]
ABLATION = [("full", 0.670, 0.504), ("no_rainfall", 0.578, 0.406), ("no_drainage", 0.531, 0.362), ("no_built_up", 0.611, 0.441), ("no_wetness", 0.631, 0.461), ("no_slope", 0.647, 0.479)]


@query("WITH m(model, prec, recall, p, n) AS (VALUES " + ", ".join(f"('{m}', {a}e0, {b}e0, {p}, {n})" for m, a, b, p, n in MODELS) + """), t AS (SELECT *, trunc(recall * p)::BIGINT AS tp FROM m),
f AS (SELECT *, CASE WHEN prec > 0 THEN trunc(tp * (1 - prec) / prec)::BIGINT ELSE 0 END AS fp FROM t) SELECT model, tp, fp, p - tp AS fn, n - fp AS tn, (tp + n - fp) / (p + n)::DOUBLE AS accuracy FROM f""")
def rebuilt_confusion(spark, sf_dir):
    return metrics.rebuilt_confusion(spark.createDataFrame(MODELS, "model string, prec double, recall double, positives long, negatives long"))


@query("WITH a(variant, f1, iou) AS (VALUES " + ", ".join(f"('{v}', {a}e0, {b}e0)" for v, a, b in ABLATION) + ") SELECT variant, f1, iou, round(0.67e0 - f1, 9) AS f1_loss, round(0.504e0 - iou, 9) AS iou_loss FROM a")
def ablation_losses(spark, sf_dir):
    return metrics.ablation(spark.createDataFrame(ABLATION, "variant string, f1 double, iou double"), "full").withColumn("f1_loss", F.round("f1_loss", 9)).withColumn("iou_loss", F.round("iou_loss", 9))


@query(S + "SELECT count(*) AS n, bool_or(isnan(pred)) AS any_nan, min(pred) = max(pred) AS constant FROM scored")
def prediction_sanity(spark, sf_dir):
    return metrics.sanity(scored(spark, sf_dir))
