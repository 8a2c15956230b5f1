"""Dated scenes: search by box, dates and mode, and per-cell median composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(scenes: DataFrame, box: tuple[float, float, float, float], start: str, end: str, mode: str | None = None, clouds_below: float | None = None) -> DataFrame:
    """Scenes (west, south, east, north, ts, mode, clouds) that meet the box (west, south, east, north) from start up to
    before end; plain comparisons, so that the scan prunes by them."""
    w, s, e, n = box
    out = scenes.filter((F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    if mode is not None:
        out = out.filter(F.col("mode") == mode)
    return out if clouds_below is None else out.filter(F.col("clouds") < clouds_below)


def median_composite(cells: DataFrame, bands: list[str], keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """The median of each band over the dates of a cell, NULLs left out."""
    return cells.groupBy(*keys).agg(*[F.percentile(b, F.lit(0.5)).alias(b) for b in bands])
