"""Patches: windows of cells as rows (patch_id, pr, pc, r, c), for training and for inference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _starts(at: Column, k: int, stride: int, most: Column) -> Column:
    """Numbers of the windows that hold position `at`: window j covers j * stride .. j * stride + k - 1, j <= most."""
    low = F.greatest(F.lit(0), F.ceil((at - k + 1) / stride)).cast("int")
    high = F.least(F.floor(at / stride).cast("int"), most)
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def sliding(cells: DataFrame, k: int, stride: int, partial: bool = False) -> DataFrame:
    """cells once for each k x k window that holds them, with pr, pc (numbers of the window); only whole windows, or
    with `partial` also those cut by the edge."""
    extent = F.broadcast(cells.agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w")))
    last = lambda n: (F.floor((F.col(n) - 1) / stride) if partial else F.floor((F.col(n) - k) / stride)).cast("int")
    out = cells.crossJoin(extent).withColumn("pr", F.explode(_starts(F.col("r"), k, stride, last("_h"))))
    return out.withColumn("pc", F.explode(_starts(F.col("c"), k, stride, last("_w")))).drop("_h", "_w")


def tiled(cells: DataFrame, k: int) -> DataFrame:
    """cells with the tile of side k that holds them: no join and no copies."""
    return cells.withColumn("pr", F.floor(F.col("r") / k).cast("int")).withColumn("pc", F.floor(F.col("c") / k).cast("int"))


def summary(patched: DataFrame, k: int, band: str, label: Column) -> DataFrame:
    """pr, pc, n, positives, peak, all_valid, whole of each patch."""
    return patched.groupBy("pr", "pc").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(label, 1).otherwise(0)).alias("positives"), F.max(band).alias("peak"),
        F.every(F.col(band).isNotNull()).alias("all_valid"), (F.count(F.lit(1)) == k * k).alias("whole"),
    )


#: Patches up to this many are broadcast to their cells; they are counted before.
BROADCAST_PATCHES = 200_000


def kept(cells: DataFrame, k: int, band: str, label: Column, wanted: Column, broadcast_rows: int = BROADCAST_PATCHES) -> DataFrame:
    """The cells of the whole tiles of side k that `wanted`, an expression over the columns of summary(), keeps; with pr, pc.

    The table of patches is aggregated from the band and the label alone.  The semi-join with it runs where cells are read
    if it can be broadcast, so that cells of other patches are never shuffled, and by shuffle beyond that."""
    marked = tiled(cells, k)
    index = summary(marked, k, band, label).filter(F.col("whole") & wanted).select("pr", "pc")
    if index.limit(broadcast_rows + 1).count() <= broadcast_rows:
        index = F.broadcast(index)
    return marked.join(index, ["pr", "pc"], "left_semi")


def balance(patches: DataFrame, positive: Column, times: int = 2, seed: int = 42, need_positive: bool = True) -> DataFrame:
    """All positive patches and at most `times` as many negative ones, those with the smallest hash of (seed, place).

    Negatives are ranked inside 4096 ranges of the hash, whose counts are broadcast; without any positive patch the job
    fails, or with `need_positive=False` gives no rows."""
    marked = patches.withColumn("_p", F.coalesce(positive, F.lit(False))).withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "pr", "pc"))).withColumn("_x", F.substring("_h", 1, 3))
    found = F.count_if("_p")
    wanted = F.broadcast(marked.agg((F.when(found == 0, F.raise_error(F.lit("no positive patches")).cast("long")).otherwise(found * times) if need_positive else found * times).alias("_want")))
    negative = marked.filter(~F.col("_p"))
    before = Window.orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges only
    ranges = negative.groupBy("_x").agg(F.count(F.lit(1)).alias("_n")).select("_x", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = negative.withColumn("_k", F.row_number().over(Window.partitionBy("_x").orderBy("_h", "pr", "pc")))
    kept = ranked.join(F.broadcast(ranges), "_x").crossJoin(wanted).filter(F.col("_k") + F.col("_before") <= F.col("_want"))
    return marked.filter("_p").select(patches.columns).unionByName(kept.select(patches.columns))


def shuffled(rows: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """rows with `place`, their number from 0 in a random order that depends on the seed and the keys alone.

    Rows are ranked inside 4096 ranges of the hash, whose counts are broadcast: no task orders all rows."""
    marked = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))).withColumn("_x", F.substring("_h", 1, 3))
    before = Window.orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges only
    ranges = marked.groupBy("_x").agg(F.count(F.lit(1)).alias("_n")).select("_x", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = marked.withColumn("_k", F.row_number().over(Window.partitionBy("_x").orderBy("_h", *keys)))
    return ranked.join(F.broadcast(ranges), "_x").select(*rows.columns, (F.col("_before") + F.col("_k") - 1).alias("place"))


def attention_gate(patched: DataFrame, skip: str, gate: str) -> DataFrame:
    """patched with `gated`: the skip band weighted by the sigmoid of the gate band (of the same cells)."""
    return patched.withColumn("gated", F.col(skip) / (1 + F.exp(-F.col(gate))))


def pool_max(patched: DataFrame, band: str, k: int = 2) -> DataFrame:
    """pr, pc, r, c, pooled: the largest value of each k x k block of a patch; r and c count blocks."""
    at = [F.floor(F.col(x) / k).cast("int").alias(x) for x in ("r", "c")]
    return patched.groupBy("pr", "pc", *at).agg(F.max(band).alias("pooled"))


def split(rows: DataFrame, key: Column, share: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with `part`: 'val' for a share of the keys by hash, else 'train'."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("part", F.when(u < share, "val").otherwise("train"))


def merge_max(patched: DataFrame, score: Column) -> DataFrame:
    """r, c, score: overlapping windows merged by their largest score."""
    return patched.groupBy("r", "c").agg(F.max(score).alias("score"))


def convolve(patched: DataFrame, band: str, kernel: list[list[float]], k: int, relu: bool = True) -> DataFrame:
    """pr, pc, r, c, score: one convolution layer over each patch (zeros outside), the patch as one small matrix."""
    weights = np.array(kernel, float)
    h = len(weights) // 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((k + 2 * h, k + 2 * h))
        r, c = (pdf["r"] - pdf["r"].min()).to_numpy(), (pdf["c"] - pdf["c"].min()).to_numpy()
        image[r + h, c + h] = pdf[band].fillna(0.0)
        out = sum(weights[i, j] * image[i : i + k, j : j + k] for i in range(2 * h + 1) for j in range(2 * h + 1))
        return pdf[["pr", "pc", "r", "c"]].assign(score=(np.maximum(out, 0) if relu else out)[r, c])

    return patched.select("pr", "pc", "r", "c", band).groupBy("pr", "pc").applyInPandas(run, "pr int, pc int, r int, c int, score double")
