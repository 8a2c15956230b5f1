"""Classification quality of rows (pred double, target double): all from one grouping by distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions.columns import ratio

from .ranks import running_totals


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn in one row."""
    p, t = F.col("pred") >= threshold, F.col("target") > 0.5
    return scored.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))


def confusion_by(scored: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn of each value of a column."""
    p, t = F.col("pred") >= threshold, F.col("target") > 0.5
    return scored.groupBy(by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))


def monotone(curves: DataFrame, key: str, values: str) -> DataFrame:
    """key, k, value: each curve's values (a short array) in growing order, NULLs left out."""
    grown = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return curves.select(key, F.posexplode(grown).alias("k", "value"))


def rates(counts: DataFrame) -> DataFrame:
    """Confusion counts with iou, dice (1 when nothing is expected or found), precision, recall, f1, specificity, accuracy."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*", ratio(tp, tp + fp + fn, 1.0).alias("iou"), ratio(2 * tp, 2 * tp + fp + fn, 1.0).alias("dice"), ratio(tp, tp + fp).alias("prec"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tn, tn + fp).alias("specificity"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def curve(scored: DataFrame) -> DataFrame:
    """score, t, f, tp, fp, p, n: targets and others at each distinct score, and cumulative counts from the highest down.

    Rows are first counted per score; running sums go over distinct scores, by ranges of them."""
    t = F.when(F.col("target") > 0.5, 1).otherwise(0)
    by = scored.groupBy(F.col("pred").alias("score")).agg(F.sum(t).alias("t"), F.sum(1 - t).alias("f"))
    whole = F.broadcast(by.agg(F.sum("t").alias("p"), F.sum("f").alias("n")))
    up = running_totals(by, "score", ["t", "f"]).crossJoin(whole)
    return up.select("score", "t", "f", (F.col("p") - F.col("t_to") + F.col("t")).alias("tp"), (F.col("n") - F.col("f_to") + F.col("f")).alias("fp"), "p", "n")


def roc_points(scored: DataFrame) -> DataFrame:
    """score, fpr, tpr."""
    return curve(scored).select("score", ratio(F.col("fp"), F.col("n")).alias("fpr"), ratio(F.col("tp"), F.col("p")).alias("tpr"))


def pr_points(scored: DataFrame) -> DataFrame:
    """score, prec, recall."""
    return curve(scored).select("score", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("prec"), ratio(F.col("tp"), F.col("p")).alias("recall"))


def areas(scored: DataFrame) -> DataFrame:
    """auc (trapezoids, ties exact; 0 for one class) and ap, the mean precision over steps of recall."""
    steps = curve(scored)
    area = F.sum(F.col("f") * (2 * F.col("tp") - F.col("t"))) / 2.0
    ap = F.sum(F.col("t") * F.col("tp") / (F.col("tp") + F.col("fp")))
    pn = F.max(F.col("p") * F.col("n"))
    return steps.agg(F.coalesce(F.when(pn > 0, area / pn), F.lit(0.0)).alias("auc"), F.coalesce(F.when(F.max("p") > 0, ap / F.max("p")), F.lit(0.0)).alias("ap"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_pred, mean_target over equal bins of 0..1; a score of exactly 1 lies in none."""
    b = F.floor(F.col("pred") * bins).cast("int")
    return scored.filter((F.col("pred") >= 0) & (F.col("pred") < 1)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred"), F.avg("target").alias("mean_target"))


def report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """metric, value: all single-number metrics, one row each."""
    wide = rates(confusion(scored, threshold)).crossJoin(F.broadcast(areas(scored)))
    names = ["iou", "dice", "prec", "recall", "f1", "specificity", "accuracy", "auc", "ap"]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")


def rebuilt_confusion(models: DataFrame) -> DataFrame:
    """model, tp, fp, fn, tn and accuracy from prec, recall, positives and negatives, cut to whole cells."""
    whole = lambda x: x.cast("long")
    tp = whole(F.col("recall") * F.col("positives"))
    fp: Column = F.when(F.col("prec") > 0, whole(tp * (1 - F.col("prec")) / F.col("prec"))).otherwise(F.lit(0).cast("long"))
    counted = models.select("model", tp.alias("tp"), fp.alias("fp"), (F.col("positives") - tp).alias("fn"), (F.col("negatives") - fp).alias("tn"))
    return counted.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def ablation(results: DataFrame, full: str) -> DataFrame:
    """variant, f1, iou and their loss against the full model."""
    base = F.broadcast(results.filter(F.col("variant") == full).agg(F.max("f1").alias("_f"), F.max("iou").alias("_i")))
    return results.crossJoin(base).select("variant", "f1", "iou", (F.col("_f") - F.col("f1")).alias("f1_loss"), (F.col("_i") - F.col("iou")).alias("iou_loss"))


def sanity(scored: DataFrame) -> DataFrame:
    """n, any_nan, constant: whether predictions are usable at all."""
    p = F.col("pred")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.isnan(p)), F.lit(False)).alias("any_nan"), F.coalesce(F.min(p) == F.max(p), F.lit(True)).alias("constant"))
