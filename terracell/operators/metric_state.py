"""Classification quality as a state of fixed size that is updated, merged and finished.

The state of rows (pred, target) is a table of at most 2 (bins + 2) rows: for each bin of the score, and each side of the
threshold, the targets and others in it and the sums of scores and of targets.  Updating is one partial aggregation; merging
states is a union and a sum; a stream keeps the same table as its state.  What is finished from the confusion counts and
the calibration bins is exact.  The areas under the curves see scores of a bin as equal: the ROC area is then at most half
the product of targets and others within bins away from the exact one, and that bound is part of the result.

Scores below 0 and from 1 on have bins of their own, -1 and `bins`; NULL and NaN scores or targets are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics

SCHEMA = "bin int, over boolean, t long, f long, sum_pred double, sum_target double"


def _binned(scored: DataFrame, bins: int, threshold: float) -> DataFrame:
    known = scored.select("pred", "target").filter("pred IS NOT NULL AND target IS NOT NULL AND NOT isnan(pred) AND NOT isnan(target)")
    at = F.floor(F.least(F.greatest(F.col("pred"), F.lit(-1.0)), F.lit(2.0)) * bins)
    bin_ = F.least(F.greatest(at, F.lit(-1)), F.lit(bins)).cast("int").alias("bin")
    return known.select(bin_, (F.col("pred") >= threshold).alias("over"), "pred", "target", (F.col("target") > 0.5).alias("hit"))


def update(scored: DataFrame, bins: int = 1000, threshold: float = 0.5) -> DataFrame:
    """The state of rows (pred, target); of a stream, its running state."""
    return _binned(scored, bins, threshold).groupBy("bin", "over").agg(F.count_if("hit").alias("t"), F.count_if(~F.col("hit")).alias("f"), F.sum("pred").alias("sum_pred"), F.sum("target").alias("sum_target"))


def merge(*states: DataFrame) -> DataFrame:
    """The state of all rows behind the given states of one number of bins and one threshold."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("bin", "over").agg(*[F.sum(c).alias(c) for c in ("t", "f", "sum_pred", "sum_target")])


def confusion(state: DataFrame) -> DataFrame:
    """tp, fp, fn, tn: exact."""
    over = F.col("over")
    total = lambda x, of: F.coalesce(F.sum(F.when(of, F.col(x))), F.lit(0)).alias
    return state.agg(total("t", over)("tp"), total("f", over)("fp"), total("t", ~over)("fn"), total("f", ~over)("tn"))


def calibration(state: DataFrame, bins: int, groups: int = 10) -> DataFrame:
    """bin, n, mean_pred, mean_target of `groups` equal parts of 0..1, which must divide the state's bins: exact."""
    if bins % groups:
        raise ValueError(f"{groups} groups do not divide {bins} bins")
    n = F.sum(F.col("t") + F.col("f"))
    part = F.floor(F.col("bin") * groups / bins).cast("int").alias("bin")
    return state.filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(part).agg(n.alias("n"), (F.sum("sum_pred") / n).alias("mean_pred"), (F.sum("sum_target") / n).alias("mean_target"))


def areas(state: DataFrame) -> DataFrame:
    """auc, auc_error (it is at most that far from the exact one), ap, from the counts of the bins."""
    by = state.groupBy("bin").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # over the bins only
    steps = by.select("t", "f", F.sum("t").over(down).alias("tp"), F.sum("f").over(down).alias("fp"))
    p, n = F.sum("t"), F.sum("f")
    both = lambda x: F.when((p > 0) & (n > 0), x / (p * n))
    auc, error = both(F.sum(F.col("f") * (2 * F.col("tp") - F.col("t"))) / 2.0), both(F.sum(F.col("t") * F.col("f")) / 2.0)
    ap = F.when(p > 0, F.sum(F.col("t") * F.col("tp") / (F.col("tp") + F.col("fp"))) / p)
    return steps.agg(*[F.coalesce(x, F.lit(0.0)).alias(n) for x, n in ((auc, "auc"), (error, "auc_error"), (ap, "ap"))])


def finish(state: DataFrame) -> DataFrame:
    """One row: confusion counts and rates, areas and their bound."""
    return metrics.rates(confusion(state)).crossJoin(F.broadcast(areas(state)))


def start_stream(scored: DataFrame, path: str, checkpoint: str, bins: int = 1000, threshold: float = 0.5):
    """Keep the state of a stream (pred, target): after each trigger, the whole state in the folder `path/batch=N`.

    The counts live in the stream's own state store, which the checkpoint recovers; a trigger that is repeated after a
    loss overwrites its own folder, so that the last folder always holds each row once."""

    def put(state: DataFrame, batch: int) -> None:
        state.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return update(scored, bins, threshold).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def last_state(spark, path: str) -> DataFrame:
    """The state after the last trigger of start_stream."""
    kept = spark.read.parquet(path)
    last = kept.agg(F.max("batch")).first()[0]
    return kept.filter(F.col("batch") == last).drop("batch")
