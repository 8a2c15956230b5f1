"""Running totals and exact percentiles in global order, without a sort of all rows in one task.

Both begin with approximate quantiles, a few numbers that come to the driver and go back into the plan as literals.  So
every part of a plan, and every attempt of a task, sees the same cuts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketches behind cuts, and values that one percentile may bring to the driver.
ACCURACY, HELD = 10_000, 200_000
EVERYTHING = (-math.inf, math.inf)


def _range_of(x: Column, cuts: list[float], first: int = 0) -> Column:
    """How many of the sorted cuts lie below x, by halving."""
    if not cuts:
        return F.lit(first)
    k = len(cuts) // 2
    return F.when(x <= cuts[k], _range_of(x, cuts[:k], first)).otherwise(_range_of(x, cuts[k + 1 :], first + k + 1))


def running_totals(rows: DataFrame, key: str, sums: list[str], buckets: int = 64) -> DataFrame:
    """rows (numeric key) with, for each column x of `sums`, x_to: the total of x over the rows whose key is at most the
    row's own; rows without a key come first.

    Keys are cut at approximate quantiles into `buckets` ranges.  A window runs inside each range, and the totals of the
    ranges before it, a table of `buckets` rows, are broadcast.  The quantiles only balance the ranges: the totals are exact
    whatever they are."""
    cuts = rows.agg(F.percentile_approx(F.col(key).cast("double"), F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(ACCURACY))).first()[0]
    own = F.when(F.col(key).isNull(), 0).otherwise(_range_of(F.col(key), sorted(set(cuts or []))))
    placed = rows.withColumn("_range", own)
    totals = placed.groupBy("_range").agg(*[F.sum(x).alias(x) for x in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges only
    offsets = totals.select("_range", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_before_{x}") for x in sums])
    inside = Window.partitionBy("_range").orderBy(key)
    joined = placed.join(F.broadcast(offsets), "_range")
    return joined.select(*rows.columns, *[(F.sum(x).over(inside) + F.col(f"_before_{x}")).alias(f"{x}_to") for x in sums])


def percentiles(cells: DataFrame, bands: dict[str, Column], wanted: dict[str, tuple[str, float]], accuracy: int = ACCURACY, held: int = HELD) -> dict[str, float | None]:
    """The percentile of each wanted (band, q) by linear interpolation between ranks; None for a band without values.

    A first scan brackets each percentile by a sketch.  A second one counts exactly what lies below its bracket and the
    different values inside, which are a share of 4 / accuracy of the rows.  While that is more than may be held, a scan
    in between counts the bracket and cuts it to about a twentieth.  A bracket that misses its ranks is opened and cut anew.
    NaN counts as missing."""
    value = {n: bands[b].cast("double") for n, (b, _) in wanted.items()}
    x = {n: F.when(~F.isnan(v), v) for n, v in value.items()}
    spread = 2.0 / accuracy
    ends = lambda q: F.array(F.lit(max(0.0, q - spread)), F.lit(min(1.0, q + spread)))
    one = cells.agg(*[F.count(x[n]).alias(f"{n}_n") for n in wanted], *[F.percentile_approx(x[n], ends(q), F.lit(accuracy)).alias(f"{n}_cut") for n, (_, q) in wanted.items()]).first()
    out: dict[str, float | None] = {n: None for n in wanted if not one[f"{n}_n"]}
    ranks = {n: (one[f"{n}_n"] - 1) * q for n, (_, q) in wanted.items() if n not in out}
    bracket = {n: tuple(one[f"{n}_cut"]) for n in ranks}
    _narrow(cells, x, ranks, bracket, {n for n in ranks if one[f"{n}_n"] * 2 * spread > held}, held)
    todo = set(ranks)
    while todo:
        below = {n: x[n] < bracket[n][0] for n in todo}
        own = {n: F.when(x[n].between(*bracket[n]), x[n]) for n in todo}
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), below[n].alias("below"), own[n].alias("x")) for n in sorted(todo)])).alias("v")
        counted = cells.select(each).select("v.*").filter("below OR x IS NOT NULL").groupBy("name", "below", "x").agg(F.count(F.lit(1)).alias("n")).collect()
        for n in sorted(todo):
            low, high, seen = None, None, sum(r["n"] for r in counted if r["name"] == n and r["below"])
            if seen > math.floor(ranks[n]):
                continue  # the bracket begins too late
            for v, k in sorted((r["x"], r["n"]) for r in counted if r["name"] == n and not r["below"]):
                seen += k
                low = v if low is None and seen > math.floor(ranks[n]) else low
                high = v if high is None and seen > math.ceil(ranks[n]) else high
            if high is not None:
                part = ranks[n] - math.floor(ranks[n])
                out[n] = low * (1 - part) + high * part if part else low
        todo -= set(out)
        for n in todo:
            bracket[n] = EVERYTHING
        _narrow(cells, x, ranks, bracket, set(todo), held)
    return out


def _narrow(cells: DataFrame, x: dict[str, Column], ranks: dict[str, float], bracket: dict[str, tuple[float, float]], large: set[str], held: int) -> None:
    """Cut the brackets of `large` until they hold few enough values, or one value that cannot be cut."""
    grid = F.array(*[F.lit(k / 64) for k in range(65)])
    while large:
        within = {n: F.when(x[n].between(*bracket[n]), x[n]) for n in large}
        row = cells.agg(*[c for n in large for c in (F.count_if(x[n] < bracket[n][0]).alias(f"{n}_b"), F.count(within[n]).alias(f"{n}_n"), F.percentile_approx(within[n], grid, F.lit(1000)).alias(f"{n}_g"))]).first()
        for n in list(large):
            below, count, g = row[f"{n}_b"], row[f"{n}_n"], row[f"{n}_g"]
            lo, hi = math.floor(ranks[n]) - below, math.ceil(ranks[n]) - below
            missed = lo < 0 or hi >= count
            new = EVERYTHING if missed else (g[max(0, int(lo / count * 64) - 1)], g[min(64, int(hi / count * 64) + 2)])
            if new == bracket[n] or count <= held and not missed:
                large.discard(n)
            bracket[n] = new if count > held or missed else bracket[n]


def percentile_row(cells: DataFrame, bands: dict[str, Column], wanted: dict[str, tuple[str, float]], exact: bool = True) -> DataFrame:
    """One row with a column for each wanted (band, q); the approximate form (`exact=False`) is one aggregation."""
    if not exact:
        return cells.agg(*[F.percentile_approx(bands[b], F.lit(q), F.lit(100_000)).cast("double").alias(n) for n, (b, q) in wanted.items()])
    found = percentiles(cells, bands, wanted)
    return cells.sparkSession.range(1).select(*[F.lit(found[n]).cast("double").alias(n) for n in wanted])


def with_percentiles(cells: DataFrame, exact: bool = True, **wanted: tuple[Column, float]) -> DataFrame:
    """cells with percentiles of columns as further columns; exact ones are literals, so the plan has no join for them."""
    bands, asked = {n: x for n, (x, _) in wanted.items()}, {n: (n, q) for n, (_, q) in wanted.items()}
    if not exact:
        return cells.crossJoin(F.broadcast(percentile_row(cells, bands, asked, exact)))
    found = percentiles(cells, bands, asked)
    return cells.select("*", *[F.lit(found[n]).cast("double").alias(n) for n in wanted])
