"""Neighbourhood operators: box means by two one-dimensional passes, and exact distances to the nearest feature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import layers as tiles
from .align import resample_bilinear

#: Cells of the rows that a distance pass takes at once.
BAND = 1 << 18


def box_mean(cells: DataFrame, bands: dict[str, Column], size: int) -> DataFrame:
    """cells with the mean of each band over size x size cells, NULLs left out, edges mirrored (the edge cell twice).

    A box is a run of columns of runs of rows, so that each cell is read 2 * size times, not size^2.  Mirrored copies
    of the cells within half a box of an edge are the only extra rows.  Windows hold one row, or one column, at a time.
    """
    h = size // 2
    marked = cells.select("*", *[b.alias(f"_{n}") for n, b in bands.items()])
    marked = marked.select("*", *[F.when(F.col(f"_{n}").isNotNull(), 1).otherwise(0).alias(f"_n_{n}") for n in bands])
    extent = F.broadcast(cells.agg(F.max("r").alias("_h"), F.max("c").alias("_w")))  # one row
    for axis, last in (("c", "_w"), ("r", "_h")):
        other = "r" if axis == "c" else "c"
        at, end = F.col(axis), F.col(last)
        copies = F.filter(F.array(at, F.when(at < h, -1 - at), F.when(at > end - h, 2 * end + 1 - at)), lambda k: k.isNotNull())
        spread = marked.crossJoin(extent).withColumn("_at", F.explode(copies))
        run = Window.partitionBy(other).orderBy("_at").rangeBetween(-h, h)
        names = [x for n in bands for x in (f"_{n}", f"_n_{n}")]
        summed = spread.select("*", *[F.sum(x).over(run).alias(f"_s{x}") for x in names])
        marked = summed.filter(F.col("_at") == at).drop("_at", "_h", "_w", *names)
        for x in names:
            marked = marked.withColumnRenamed(f"_s{x}", x)
    out = marked.select("*", *[F.when(F.col(f"_n_{n}") > 0, F.col(f"_{n}") / F.col(f"_n_{n}")).alias(n) for n in bands])
    return out.drop(*[x for n in bands for x in (f"_{n}", f"_n_{n}")])


def position_index(cells: DataFrame, band: str = "dem", size: int = 11) -> DataFrame:
    """Height above the mean of the neighbourhood."""
    return box_mean(cells, {"_mean": F.col(band)}, size).withColumn("tpi", F.col(band) - F.col("_mean")).drop("_mean")


def lee_filter(cells: DataFrame, band: str, size: int = 5) -> DataFrame:
    """Speckle filter: the local mean, and more of the cell's own value where the local variance is large."""
    x = F.col(band)
    noise = F.broadcast(cells.agg(F.var_pop(x).alias("_noise")))
    local = box_mean(cells, {"_m": x, "_m2": x * x}, size).crossJoin(noise)
    v = F.col("_m2") - F.col("_m") * F.col("_m")
    w = v / (v + F.col("_noise") + 1e-6)
    return local.withColumn("lee", F.col("_m") + w * (x - F.col("_m"))).drop("_m", "_m2", "_noise")


#: For each direction of the largest gradient, its two sides as offsets of 3 x 3 means, and as a plane of
#: which each side is one half, where (row, column) . plane <= 0 or >= 0.
SIDES = [((0, -2), (0, 2), (0, 1)), ((-2, -2), (2, 2), (1, 1)), ((-2, 0), (2, 0), (1, 0)), ((-2, 2), (2, -2), (1, -1))]


def _shifted(x: np.ndarray, i: int, j: int) -> np.ndarray:
    """x at (row + i, column + j), NaN beyond the edge."""
    rows, cols = x.shape
    h = max(abs(i), abs(j), 1)
    return np.pad(x, h, constant_values=np.nan)[h + i : h + i + rows, h + j : h + j + cols]


def _window_stats(x: np.ndarray, offsets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance over the cells at the offsets, NaN left out."""
    n, s, q = (np.zeros(x.shape) for _ in range(3))
    for i, j in offsets:
        v = _shifted(x, i, j)
        has = ~np.isnan(v)
        v = np.where(has, v, 0.0)
        n, s, q = n + has, s + v, q + v * v
    mean = np.where(n > 0, s / np.maximum(n, 1), np.nan)
    return mean, np.maximum(q / np.maximum(n, 1) - np.nan_to_num(mean) ** 2, 0)


def refined_lee_of(x: np.ndarray, looks: float) -> np.ndarray:
    """The filter on one array with NaN for missing cells."""
    x = np.pad(x, 3, constant_values=np.nan)  # 3 x 3 means around places beyond the edge still see its cells
    mean, _ = _window_stats(x, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    m = {(i, j): np.where(np.isnan(_shifted(mean, i, j)), mean, _shifted(mean, i, j)) for i in (-2, 0, 2) for j in (-2, 0, 2)}
    gradient, side = [], []
    for one, other, plane in SIDES:
        part = lambda sign: sum(v for (i, j), v in m.items() if sign * (i * plane[0] + j * plane[1]) > 0)
        gradient.append(np.abs(part(-1) - part(1)))
        side.append(np.abs(m[other] - m[0, 0]) < np.abs(m[one] - m[0, 0]))
    direction = np.argmax(np.nan_to_num(np.stack(gradient), nan=-1.0), axis=0)
    out = np.full(x.shape, np.nan)
    window = [(i, j) for i in range(-3, 4) for j in range(-3, 4)]
    for k, (_, _, plane) in enumerate(SIDES):
        for s, sign in enumerate((1, -1)):
            mean, var = _window_stats(x, [(i, j) for i, j in window if sign * (i * plane[0] + j * plane[1]) <= 0])
            own = (direction == k) & (side[k] == bool(s))
            signal = np.maximum(var - mean * mean / looks, 0) / (1 + 1 / looks)
            weight = np.where(var > 1e-12, signal / np.maximum(var, 1e-12), 0.0)
            out = np.where(own, mean + weight * (x - mean), out)
    return np.where(np.isnan(x), np.nan, out)[3:-3, 3:-3]


def refined_lee(cells: DataFrame, band: str, looks: float = 4.0, tile: int = 256) -> DataFrame:
    """r, c, lee: speckle filter over 7 x 7 cells along edges.

    Means of 3 x 3 cells, two cells apart, give the direction of the largest gradient and the side that is more like the
    middle; mean and variance come from that half of the window, and multiplicative noise of `looks` looks decides how much
    of a cell's own value stays.  Missing cells, and those beyond the edge, have no weight; a missing cell stays missing.
    Tiles carry a halo of three cells, so that every cell sees its whole window in one tile."""
    halo, step = 3, tile
    side = tile + 2 * halo
    scored = tiles.over_tiles(cells.select("r", "c", F.col(band).cast("double").alias(band)), [band], lambda x: refined_lee_of(x[0], looks), side, step, missing=np.nan)
    owner = lambda at: F.greatest(F.lit(0), F.floor((F.col(at) - halo) / step))
    own = scored.filter((F.col("pr") == owner("r")) & (F.col("pc") == owner("c")))
    return own.select("r", "c", F.when(~F.isnan("score"), F.col("score")).alias("lee"))


def _nearest_in_rows(row_of: np.ndarray, x: np.ndarray, first: np.ndarray, past: np.ndarray, at: np.ndarray, g: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place (row number row_of, column x, sorted by both) the index of the source of its row that is nearest.

    The sources first[k] .. past[k] - 1 of row k are parabolas g + (x - at)^2 with growing at.  The best source of a place
    moves right with it, whatever is chosen among equals.  So the middle place of every stretch of every row is judged
    first, by all sources that its stretch may use, and halves the stretch and its sources: all rows at once, a number of
    passes that grows with the logarithm of the width, and about one look at each source in a pass.  Of equal distances the
    source of the smallest rank is taken; a row without sources gives -1."""
    out = np.full(len(x), -1, np.int64)
    cuts = np.flatnonzero(np.diff(row_of, prepend=-1))
    lo, hi, row = cuts, np.append(cuts[1:], len(x)) - 1, row_of[cuts]
    a, b = first[row], past[row] - 1
    while True:
        live = (lo <= hi) & (a <= b)
        lo, hi, a, b = lo[live], hi[live], a[live], b[live]
        if not len(lo):
            return out
        middle = (lo + hi) // 2
        width = b - a + 1
        starts = np.cumsum(width) - width
        source = np.arange(width.sum()) - np.repeat(starts - a, width)
        cost = g[source] + (np.repeat(x[middle], width) - at[source]) ** 2
        least = np.minimum.reduceat(cost, starts)
        place = np.where(cost == np.repeat(least, width), rank[source], np.iinfo(np.int64).max)
        best = np.minimum.reduceat(place, starts)
        chosen = source[np.flatnonzero(place == np.repeat(best, width))]
        out[middle] = chosen
        lo, hi, a, b = np.concatenate([lo, middle + 1]), np.concatenate([middle - 1, hi]), np.concatenate([a, chosen]), np.concatenate([chosen, b])


def nearest_features(cells: DataFrame, layers: dict[str, Column], carry: str | None = None, cell: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """cells (r, c and the columns `keep`, which are doubles) with, for each layer, {layer}_distance, {layer}_r, {layer}_c and
    {layer}_carried: the nearest cell that is a feature of the layer, and the carried band there.

    Exact and separable, all layers in one pass.  Pass 1, windows over columns: the nearest feature above and below in
    the cell's own column.  Pass 2, over the whole rows of a partition, in bands of about BAND cells: the nearest of a
    row's columns, all rows of a band at once.  Of equal distances the smallest (row, column) counts; without any feature
    all is NULL.
    """
    up, down = Window.partitionBy("c").orderBy("r"), Window.partitionBy("c").orderBy(F.desc("r"))
    carried = F.col(carry).cast("double") if carry else F.lit(0.0)
    names = list(layers)
    value = {n: F.when(f, F.struct(F.col("r").alias("r"), carried.alias("v"))) for n, f in layers.items()}
    ends = [x for n, v in value.items() for x in (F.last(v, True).over(up).alias(f"{n}_a"), F.last(v, True).over(down).alias(f"{n}_b"))]
    near = cells.select("r", "c", *keep, *ends)

    def first(n: str) -> Column:
        a, b = F.col(f"{n}_a"), F.col(f"{n}_b")
        return F.when(b.isNull() | (F.col("r") - a["r"] <= b["r"] - F.col("r")), a).otherwise(b)

    both = near.select("r", "c", *keep, *[first(n).alias(n) for n in layers])
    columns = both.select("r", "c", *keep, *[x for n in layers for x in (F.col(f"{n}.r").cast("double").alias(f"{n}_r"), F.col(f"{n}.v").alias(f"{n}_v"))])

    held = ["c", *keep, *[f"{n}_{k}" for n in names for k in ("r", "v")]]

    def band(r: np.ndarray, x: dict[str, np.ndarray]) -> pa.RecordBatch:
        row_of = np.cumsum(np.diff(r, prepend=r[0]) != 0)
        c, rows = x["c"].astype(np.int64), r[np.flatnonzero(np.diff(r, prepend=r[0] - 1))].astype(np.int64)
        out = [pa.array(r, pa.int32()), pa.array(c, pa.int32()), *(_doubles(x[k]) for k in keep)]
        for n in names:
            has = np.flatnonzero(~np.isnan(x[f"{n}_r"]))
            fr, fc, owner = x[f"{n}_r"][has].astype(np.int64), c[has], row_of[has]
            rank = np.empty(len(has), np.int64)
            rank[np.lexsort((fc, fr))] = np.arange(len(has))
            first = np.searchsorted(owner, np.arange(len(rows) + 1))
            i = _nearest_in_rows(row_of, c, first[:-1], first[1:], fc, (fr - rows[owner]) ** 2, rank)
            none = i < 0
            if len(has):
                distance, carried = np.sqrt(((fr[i] - r) ** 2 + (c - fc[i]) ** 2).astype(float)) * cell, x[f"{n}_v"][has][i]
                out += [pa.array(distance, mask=none), pa.array(fr[i], pa.int32(), mask=none), pa.array(fc[i], pa.int32(), mask=none), pa.array(carried, mask=none | np.isnan(carried))]
            else:
                out += [pa.nulls(len(c), t) for t in (pa.float64(), pa.int32(), pa.int32(), pa.float64())]
        return pa.RecordBatch.from_arrays(out, ["r", "c", *keep, *[f"{n}_{k}" for n in names for k in ("distance", "r", "c", "carried")]])

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole rows, about BAND cells at a time."""
        r, parts = np.empty(0, np.int64), {k: np.empty(0) for k in held}
        for b in batches:
            if not b.num_rows:
                continue
            r = np.concatenate([r, b.column("r").to_numpy().astype(np.int64)])
            parts = {k: np.concatenate([v, b.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False)]) for k, v in parts.items()}
            whole = int(np.searchsorted(r, r[-1]))  # the last row may go on
            if whole >= BAND:
                yield band(r[:whole], {k: v[:whole] for k, v in parts.items()})
                r, parts = r[whole:], {k: v[whole:] for k, v in parts.items()}
        if len(r):
            yield band(r, parts)

    schema = "r int, c int" + "".join(f", {k} double" for k in keep) + "".join(f", {n}_distance double, {n}_r int, {n}_c int, {n}_carried double" for n in layers)
    return columns.repartition("r").sortWithinPartitions("r", "c").mapInArrow(bands, schema)


def _doubles(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=np.isnan(x))


def nearest_feature(cells: DataFrame, feature: Column, carry: str | None = None, cell: float = 1.0) -> DataFrame:
    """r, c, distance, near_r, near_c, carried: nearest_features for one layer."""
    near = nearest_features(cells, {"f": feature}, carry, cell)
    return near.select("r", "c", F.col("f_distance").alias("distance"), F.col("f_r").alias("near_r"), F.col("f_c").alias("near_c"), F.col("f_carried").alias("carried"))


def height_above_drainage(cells: DataFrame, drainage: Column, band: str = "dem") -> DataFrame:
    """r, c, hand, near_r, near_c: height above the nearest drainage cell that has a height; NULL without one."""
    own = cells.withColumn(band, F.col(band).cast("double"))
    near = nearest_features(own, {"f": drainage & F.col(band).isNotNull()}, carry=band, keep=(band,))
    return near.select("r", "c", (F.col(band) - F.col("f_carried")).alias("hand"), F.col("f_r").alias("near_r"), F.col("f_c").alias("near_c"))


def height_above_drainage_coarse(cells: DataFrame, drainage: Column, band: str = "dem", factor: int = 4) -> DataFrame:
    """r, c, hand, by way of a grid `factor` times coarser: the nearest cell of each coarse place, heights there, and a
    bilinear way back with the grids' first and last cells on each other.

    Cells beyond factor times the coarse side are NULL, as are places without a height around them; a grid of fewer than
    two coarse rows or columns has no scale and is NULL throughout."""
    extent = F.broadcast(cells.agg(*[F.max(x).alias(f"_n{x}") for x in ("r", "c")]).select(
        "*", *[F.bround((F.col(f"_n{x}") + 1) / F.lit(float(factor))).cast("int").alias(f"_m{x}") for x in ("r", "c")]))
    last = lambda x: F.when(F.col(f"_m{x}") > 1, F.col(f"_m{x}") - 1)
    # a source cell may be the nearest of no coarse place or of one: its place is found from the cell, without a join
    place = lambda x: F.floor(F.col(x) * last(x) / F.col(f"_n{x}") + 0.5)
    source = lambda x: F.floor(F.col(f"_i{x}") * F.col(f"_n{x}") / last(x) + 0.5)
    sampled = cells.withColumn("_d", drainage).crossJoin(extent).withColumn("_ir", place("r")).withColumn("_ic", place("c"))
    sampled = sampled.filter((source("r") == F.col("r")) & (source("c") == F.col("c")))
    coarse = sampled.select(F.col("_ir").cast("int").alias("r"), F.col("_ic").cast("int").alias("c"), band, "_d")
    hand = height_above_drainage(coarse, F.col("_d"), band).select("r", "c", "hand")
    side = lambda x: F.col(f"_m{x}") * factor
    fine = cells.select("r", "c").crossJoin(extent)
    back = lambda x: F.when((F.col("r") < side("r")) & (F.col("c") < side("c")), F.col(x) * last(x) / (side(x) - 1) + 0.5)
    return resample_bilinear(hand, fine.withColumn("_tr", back("r")).withColumn("_tc", back("c")), F.col("_tr"), F.col("_tc"), "hand")
