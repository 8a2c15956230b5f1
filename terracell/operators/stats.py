"""Scalar statistics of bands, taken in one aggregation and joined back as a single row; normalisation with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions.columns import clip

from .ranks import with_percentiles


def with_stats(cells: DataFrame, **stats: Column) -> DataFrame:
    """cells with whole-table aggregates as columns: one partial aggregation and a broadcast of one row."""
    return cells.crossJoin(F.broadcast(cells.agg(*[c.alias(n) for n, c in stats.items()])))


def minmax(cells: DataFrame, band: str, out: str, epsilon: float = 1e-6) -> DataFrame:
    x = F.col(band)
    return with_stats(cells, _mn=F.min(x), _mx=F.max(x)).withColumn(out, (x - F.col("_mn")) / (F.col("_mx") - F.col("_mn") + epsilon)).drop("_mn", "_mx")


def minmax_or_zero(cells: DataFrame, band: str, out: str) -> DataFrame:
    """No epsilon; a constant band gives 0."""
    x, span = F.col(band), F.col("_mx") - F.col("_mn")
    return with_stats(cells, _mn=F.min(x), _mx=F.max(x)).withColumn(out, F.when(x.isNotNull(), F.when(span == 0, 0.0).otherwise((x - F.col("_mn")) / span))).drop("_mn", "_mx")


def minmax_of_nonzero(cells: DataFrame, band: str, out: str) -> DataFrame:
    """Range of the cells that are not 0, applied to all; a band without such a range stays as it is."""
    x, used = F.col(band), F.when(F.col(band) != 0, F.col(band))
    span = F.col("_mx") - F.col("_mn")
    return with_stats(cells, _mn=F.min(used), _mx=F.max(used)).withColumn(out, F.when(span > 1e-6, (x - F.col("_mn")) / span).otherwise(x)).drop("_mn", "_mx")


def stored_range(cells: DataFrame, stats: DataFrame, band: str, out: str) -> DataFrame:
    """Range from a table of one row for each band (band, mn, mx); a band that it lacks has the range 0..1."""
    own = stats.filter(F.col("band") == band).agg(F.coalesce(F.max("mn"), F.lit(0.0)).alias("_mn"), F.coalesce(F.max("mx"), F.lit(1.0)).alias("_mx"))
    scaled = clip((F.col(band) - F.col("_mn")) / (F.col("_mx") - F.col("_mn") + 1e-6), 0.0, 1.0)
    return cells.crossJoin(F.broadcast(own)).withColumn(out, scaled).drop("_mn", "_mx")


def robust_bands(cells: DataFrame, bands: dict[str, str], exact: bool = True) -> DataFrame:
    """Percentiles 1 and 99 of each band (band: name of the result) to 0..1, clipped; missing cells and a band without
    cells give 0."""
    wanted = {f"_{end}_{out}": (F.col(b), q) for b, out in bands.items() for end, q in (("lo", 0.01), ("hi", 0.99))}
    scaled = lambda b, out: clip((F.col(b) - F.col(f"_lo_{out}")) / F.greatest(F.col(f"_hi_{out}") - F.col(f"_lo_{out}"), F.lit(1e-6)), 0.0, 1.0)
    return with_percentiles(cells, exact, **wanted).select(*cells.columns, *[F.coalesce(scaled(b, out), F.lit(0.0)).alias(out) for b, out in bands.items()])


def robust(cells: DataFrame, band: str, out: str, exact: bool = True) -> DataFrame:
    return robust_bands(cells, {band: out}, exact)


def histogram(cells: DataFrame, band: str, bins: int = 50) -> DataFrame:
    """bin (from 0), lo, hi, n over the band's own range; the last bin is closed."""
    x, w = F.col(band), (F.col("_mx") - F.col("_mn")) / bins
    at = F.least(F.floor(F.when(w > 0, (x - F.col("_mn")) / w).otherwise(0.0)), F.lit(bins - 1)).cast("int")
    own = with_stats(cells.filter(x.isNotNull()), _mn=F.min(x), _mx=F.max(x))
    return own.groupBy(at.alias("bin"), (F.col("_mn") + at * w).alias("lo"), (F.col("_mn") + (at + 1) * w).alias("hi")).agg(F.count(F.lit(1)).alias("n"))


def profile(cells: DataFrame, bands: list[str]) -> DataFrame:
    """band, n, n_null, n_zero, mn, mx, mean, var of each band in one pass over the cells."""
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("x")) for b in bands]))
    return cells.select(each.alias("s")).select("s.*").groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("n_null"), F.count_if(F.col("x") == 0).alias("n_zero"),
        F.min("x").alias("mn"), F.max("x").alias("mx"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"),
    )


def otsu(cells: DataFrame, band: str, bins: int = 64) -> DataFrame:
    """threshold: the histogram bound with the largest variance between the two sides (the lowest of equals)."""
    from pyspark.sql import Window

    h = histogram(cells, band, bins)
    mid = (F.col("lo") + F.col("hi")) / 2
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # over the bins only
    whole = Window.partitionBy()
    parts = h.select("hi", "bin", F.sum("n").over(below).alias("n0"), F.sum(F.col("n") * mid).over(below).alias("s0"), F.sum("n").over(whole).alias("n1"), F.sum(F.col("n") * mid).over(whole).alias("s1"))
    n0, n1 = F.col("n0"), F.col("n1") - F.col("n0")
    gap = F.col("s0") / n0 - (F.col("s1") - F.col("s0")) / n1
    scored = parts.filter(n1 > 0).select("hi", "bin", (n0 * n1 * gap * gap).alias("between"))
    return scored.agg(F.max_by("hi", F.struct("between", -F.col("bin"))).alias("threshold"))
