"""Alignment: bands of different grids on one grid, overviews, and points on the grid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(*bands: DataFrame) -> DataFrame:
    """Bands on common cells; a smaller grid crops the others, because the join keeps only shared keys."""
    out = bands[0]
    for b in bands[1:]:
        out = out.join(b, ["r", "c"])
    return out


def resample_nearest(cells: DataFrame, target: DataFrame, row: Column, col: Column, bands: list[str]) -> DataFrame:
    """target (r, c) with the bands of the source cell that holds (row, col), the target's place in source cells."""
    keyed = target.select("r", "c", F.floor(row).cast("int").alias("_r"), F.floor(col).cast("int").alias("_c"))
    source = cells.select(F.col("r").alias("_r"), F.col("c").alias("_c"), *bands)
    return keyed.join(source, ["_r", "_c"], "left").drop("_r", "_c")


def resample_bilinear(cells: DataFrame, target: DataFrame, row: Column, col: Column, band: str) -> DataFrame:
    """target (r, c) with the band between the four source cells around (row, col), by centres; NULLs get no weight.

    Four rows for each target cell meet the source in an equi-join and are summed again, whatever the grids' sizes.
    """
    y, x = row - 0.5, col - 0.5
    at = target.select("r", "c", F.floor(y).cast("int").alias("_y"), F.floor(x).cast("int").alias("_x"), y.alias("_fy"), x.alias("_fx"))
    corners = at.withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])))
    weight = (1 - F.abs(F.col("_fy") - F.col("_y") - F.col("o.i"))) * (1 - F.abs(F.col("_fx") - F.col("_x") - F.col("o.j")))
    keyed = corners.select("r", "c", (F.col("_y") + F.col("o.i")).alias("_r"), (F.col("_x") + F.col("o.j")).alias("_c"), weight.alias("w"))
    source = cells.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(band).alias("_v"))
    used = F.when(F.col("_v").isNotNull(), F.col("w"))
    summed = keyed.join(source, ["_r", "_c"], "left").groupBy("r", "c").agg(F.sum(used * F.col("_v")).alias("_s"), F.sum(used).alias("_n"))
    return summed.select("r", "c", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias(band))


def zoom(cells: DataFrame, band: str, factor: float, order: int = 1, tile: int = 256) -> DataFrame:
    """r, c, band (double) on a grid of round(size * factor) cells a side (halves to even), whose first and last cells lie on
    those of the source: the nearest cell (order 0) or between four (order 1).  The grid's size, two numbers, comes to the
    driver."""
    sides = [0 if n is None else n + 1 for n in cells.agg(F.max("r"), F.max("c")).first()]
    sizes = [round(n * factor) for n in sides]
    step = [(n - 1) / (m - 1) if m > 1 else 0.0 for n, m in zip(sides, sizes)]
    tiles = target_tiles(F.lit(sizes[0]), F.lit(sizes[1]), cells.sparkSession.range(1), tile)
    at = lambda r, c: (r * step[0] + 0.5, c * step[1] + 0.5)
    return resample(cells, at, tiles, *(([band], []) if order == 0 else ([], [band])), tile)


def downsample(cells: DataFrame, factor: int, means: list[str] = (), modes: list[str] = ()) -> DataFrame:
    """An overview of factor x factor blocks: means of continuous bands, most frequent codes (the least of equals)."""
    key = [F.floor(F.col(x) / factor).cast("int").alias(x) for x in ("r", "c")]
    out = cells.select(*key, *means, *modes)
    averaged = out.groupBy("r", "c").agg(*[F.avg(b).alias(b) for b in means], F.count(F.lit(1)).alias("n_cells"))
    for b in modes:
        counted = out.filter(F.col(b).isNotNull()).groupBy("r", "c", b).agg(F.count(F.lit(1)).alias("_n"))
        averaged = averaged.join(counted.groupBy("r", "c").agg(F.max_by(b, F.struct("_n", -F.col(b))).alias(b)), ["r", "c"], "left")
    return averaged


def overview(cells: DataFrame, most: int, means: list[str] = (), modes: list[str] = ()) -> DataFrame:
    """The overview whose longest side has at most `most` cells; the factor is found from the grid's extent (one row)."""
    side = max((x or 0) + 1 for x in cells.agg(F.max("r"), F.max("c")).first())
    return downsample(cells, -(-side // most), means, modes)


def corner(cells: DataFrame, side: int = 1000) -> DataFrame:
    """The first side x side cells, as a sample for a quick look."""
    return cells.filter((F.col("r") < side) & (F.col("c") < side))


def lookup(points: DataFrame, cells: DataFrame, bands: list[str], broadcast_rows: int = 100_000) -> DataFrame:
    """points (r, c, ...) with the bands of their cell, NULL outside.

    The places of the points are broadcast when there are at most `broadcast_rows` (counted before), so that cells are
    filtered where they are read; beyond that they are joined by shuffle."""
    places = points.select("r", "c").distinct()
    if places.limit(broadcast_rows + 1).count() <= broadcast_rows:
        places = F.broadcast(places)
    return points.join(cells.select("r", "c", *bands).join(places, ["r", "c"], "left_semi"), ["r", "c"], "left")


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether (x, y) lies in a closed ring, by the parity of the edges to its right (half-open in y)."""
    edges = [F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("y0"), F.lit(float(c)).alias("x1"), F.lit(float(d)).alias("y1")) for (a, b), (c, d) in zip(ring, ring[1:])]
    crosses = lambda e: F.when((e["y0"] > y) != (e["y1"] > y), x < (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]).otherwise(False)
    return F.aggregate(F.array(*edges), F.lit(0), lambda n, e: n + F.when(crosses(e), 1).otherwise(0)) % 2 == 1


#: Pairs of target and source tiles up to this many are broadcast; they are counted before.
BROADCAST_PAIRS = 100_000


def target_tiles(height: Column, width: Column, extent: DataFrame, tile: int) -> DataFrame:
    """tr, tc and the grid's height and width for each tile of a grid whose size is given by columns of a one-row table."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.floor((n - 1) / tile).cast("int")))
    rows = extent.select(height.cast("int").alias("_h"), width.cast("int").alias("_w")).filter("_h > 0 AND _w > 0")
    return rows.select("_h", "_w", each(F.col("_h")).alias("tr")).repartition("tr").select("_h", "_w", "tr", each(F.col("_w")).alias("tc"))


def _source_place(r: Column, c: Column, transform: tuple, inverse, source_transform: tuple) -> tuple[Column, Column]:
    """Fractional row and column in the source of the centre of a target cell."""
    a, b, x0, d, e, y0 = transform
    x, y = inverse(a * (c + 0.5) + b * (r + 0.5) + x0, d * (c + 0.5) + e * (r + 0.5) + y0)
    a, b, x0, d, e, y0 = source_transform
    det = a * e - b * d
    return (a * (y - y0) - d * (x - x0)) / det, (e * (x - x0) - b * (y - y0)) / det


def _interpolated(values: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Between the centres of four cells; NaN cells, and those outside, get no weight."""
    total, weight = np.zeros(len(y)), np.zeros(len(y))
    fy, fx = y - 0.5, x - 0.5
    for i in (0, 1):
        for j in (0, 1):
            r, c = np.floor(fy).astype(int) + i, np.floor(fx).astype(int) + j
            inside = (r >= 0) & (r < values.shape[0]) & (c >= 0) & (c < values.shape[1])
            v = np.where(inside, values[np.where(inside, r, 0), np.where(inside, c, 0)], np.nan)
            w = np.where(np.isnan(v), 0.0, (1 - np.abs(fy - r)) * (1 - np.abs(fx - c)))
            total, weight = total + w * np.nan_to_num(v), weight + w
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), np.nan)


def _nearest(values: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    r, c = np.floor(y).astype(int), np.floor(x).astype(int)
    inside = (r >= 0) & (r < values.shape[0]) & (c >= 0) & (c < values.shape[1])
    return np.where(inside, values[np.where(inside, r, 0), np.where(inside, c, 0)], np.nan)


def reproject(cells: DataFrame, source_transform: tuple, target: DataFrame, transform: tuple, inverse, nearest: list[str] = (), bilinear: list[str] = (), tile: int = 256) -> DataFrame:
    """resample() to a grid in another reference system: inverse(x, y) gives columns of source coordinates for target
    coordinates, the transforms map cells to coordinates."""
    return resample(cells, lambda r, c: _source_place(r, c, transform, inverse, source_transform), target, nearest, bilinear, tile)


def resample(cells: DataFrame, place, target: DataFrame, nearest: list[str] = (), bilinear: list[str] = (), tile: int = 256) -> DataFrame:
    """r, c and the bands (doubles) of every cell of a target grid; NULL stays NULL and is where the source does not reach.

    target: the tiles of target_tiles; place(r, c) gives the fractional row and column in the source (a cell's centre at
    one half) of a target cell, as columns.  The cells on the frame of a target tile are placed first: as the mapping bends
    no tile inside out, the box around them, one cell wider, holds the source cells of the whole tile.  Source cells go to
    the tiles whose boxes hold them, with a few along the borders going to two, by source tiles of the same side; so a cell
    is shuffled about once whatever the method, and target cells are made where their tile is."""
    bands = [*nearest, *bilinear]
    span = lambda t, n: F.least(F.lit(tile), F.col(n) - F.col(t) * tile)  # noqa: E731  rows or columns of a tile
    step = F.explode(F.sequence(F.lit(0), F.greatest(span("tr", "_h"), span("tc", "_w")) - 1)).alias("k")
    edges = F.explode(F.array(*[F.struct(r.alias("i"), c.alias("j")) for r, c in ((F.lit(0), F.col("k")), (span("tr", "_h") - 1, F.col("k")), (F.col("k"), F.lit(0)), (F.col("k"), span("tc", "_w") - 1))])).alias("e")
    frame = target.select("*", step).select("*", edges).filter((F.col("e.i") < span("tr", "_h")) & (F.col("e.j") < span("tc", "_w")))
    y, x = place(F.col("tr") * tile + F.col("e.i"), F.col("tc") * tile + F.col("e.j"))
    low, high = (lambda v: F.floor(F.min(v)).cast("int") - 2), (lambda v: F.floor(F.max(v)).cast("int") + 2)
    boxes = frame.groupBy("tr", "tc").agg(low(y).alias("_r0"), high(y).alias("_r1"), low(x).alias("_c0"), high(x).alias("_c1"))
    each = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile)))
    pairs = boxes.withColumn("_sr", each("_r0", "_r1")).withColumn("_sc", each("_c0", "_c1"))
    if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    source = cells.select("r", "c", *[F.col(b).cast("double").alias(b) for b in bands], F.floor(F.col("r") / tile).alias("_sr"), F.floor(F.col("c") / tile).alias("_sc")).join(pairs, ["_sr", "_sc"])
    source = source.filter(F.col("r").between(F.col("_r0"), F.col("_r1")) & F.col("c").between(F.col("_c0"), F.col("_c1"))).select(F.col("tr").alias("_tr"), F.col("tc").alias("_tc"), "r", "c", *bands)
    own = target.repartition("tr", "tc").select("*", F.explode(F.sequence(F.lit(0), span("tr", "_h") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), span("tc", "_w") - 1)).alias("j"))
    r, c = F.col("tr") * tile + F.col("i"), F.col("tc") * tile + F.col("j")
    y, x = place(r, c)
    own = own.select("tr", "tc", r.cast("int").alias("r"), c.cast("int").alias("c"), y.alias("y"), x.alias("x"))

    def fill(wanted: pa.Table, held: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return pa.table({"r": pa.array([], pa.int32()), "c": pa.array([], pa.int32()), **{b: pa.array([], pa.float64()) for b in bands}})
        out, at = {"r": wanted.column("r"), "c": wanted.column("c")}, [held.column(k).to_numpy() for k in ("r", "c")]
        r0, c0 = (int(a.min()) if len(a) else 0 for a in at)
        shape = tuple(int(a.max()) - s + 1 if len(a) else 1 for a, s in zip(at, (r0, c0)))
        y, x = wanted.column("y").to_numpy() - r0, wanted.column("x").to_numpy() - c0
        for b in bands:
            values = np.full(shape, np.nan)
            values[at[0] - r0, at[1] - c0] = held.column(b).to_numpy()  # NULL as NaN
            v = _nearest(values, y, x) if b in nearest else _interpolated(values, y, x)
            out[b] = pa.array(v, mask=np.isnan(v))
        return pa.table(out)

    schema = ", ".join(["r int", "c int", *(f"{b} double" for b in bands)])
    return own.groupBy("tr", "tc").cogroup(source.groupBy("_tr", "_tc")).applyInArrow(fill, schema)
