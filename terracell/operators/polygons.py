"""Polygons on a grid by scan conversion: edges to intervals of columns for each row, then a range join with the cells.

A cell belongs to a feature if its centre lies inside an odd number of the feature's rings, so that holes and several
parts need no special case.  Work grows with the boundary (one crossing for each edge and row that it passes) and with the
cells, not with their product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Intervals up to this many are broadcast to the cells; they are counted before.
BROADCAST_INTERVALS = 200_000


def edges(rings: DataFrame) -> DataFrame:
    """feature, x0, y0, x1, y1 of rings (feature, ring, point, x, y); a ring that is not closed gets its last edge."""
    order = Window.partitionBy("feature", "ring").orderBy("point")
    first = F.first(F.struct("x", "y")).over(order)
    after = F.coalesce(F.lead(F.struct("x", "y")).over(order), first)
    out = rings.select("feature", F.col("x").alias("x0"), F.col("y").alias("y0"), after.alias("_n"))
    return out.select("feature", "x0", "y0", F.col("_n.x").alias("x1"), F.col("_n.y").alias("y1"))


def intervals(edges: DataFrame) -> DataFrame:
    """feature, r, c0, c1: the cells c0 <= c <= c1 of row r whose centres lie inside the feature; edges in cells (x along
    columns, y along rows, a cell's corner at its number).  Edges are half-open in y, intervals in x; NULL points are left out."""
    known = edges.filter("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    low, high = F.ceil(F.least("y0", "y1") - 0.5).cast("int"), F.ceil(F.greatest("y0", "y1") - 0.5).cast("int") - 1
    passed = known.filter(low <= high).select("*", F.explode(F.sequence(low, high)).alias("r"))
    x = (F.col("x1") - F.col("x0")) * (F.col("r") + 0.5 - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    order = Window.partitionBy("feature", "r").orderBy("x")  # the crossings of one row of one feature
    crossed = passed.select("feature", "r", x.alias("x")).select("*", F.row_number().over(order).alias("k"), F.lead("x").over(order).alias("past"))
    out = crossed.filter("k % 2 = 1").select("feature", "r", F.ceil(F.col("x") - 0.5).cast("int").alias("c0"), (F.ceil(F.col("past") - 0.5) - 1).cast("int").alias("c1"))
    return out.filter("c0 <= c1")


def inside(cells: DataFrame, rings: DataFrame, broadcast_rows: int = BROADCAST_INTERVALS) -> DataFrame:
    """feature beside the columns of cells (r, c, ...), one row for each feature that holds the cell."""
    spans = intervals(edges(rings)).select("feature", F.col("r").alias("_r"), "c0", "c1")
    if spans.limit(broadcast_rows + 1).count() <= broadcast_rows:
        spans = F.broadcast(spans)
    return cells.join(spans, (F.col("r") == F.col("_r")) & F.col("c").between(F.col("c0"), F.col("c1"))).select("feature", *cells.columns)


def to_cells(rings: DataFrame, transform: tuple[float, float, float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    """rings with map coordinates as columns and rows of a grid."""
    a, b, x0, d, e, y0 = transform
    det = a * e - b * d
    col = (e * (F.col(x) - x0) - b * (F.col(y) - y0)) / det
    row = (a * (F.col(y) - y0) - d * (F.col(x) - x0)) / det
    return rings.select("feature", "ring", "point", col.alias("x"), row.alias("y"))
