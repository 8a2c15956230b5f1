"""Served jobs: run what is missing and read its figures back, overlays with their bounds, and searches by name."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions import columns as fn
from terracell.sources import raster, tiles

from . import align

#: Needles up to this many are broadcast to the names; they are counted before.
BROADCAST_NEEDLES = 10_000


def predict(spark: SparkSession, prob: dict[int, DataFrame], folder: str, transform: tuple | None = None, epsg: int | None = None, sheet: int = 4096, block: int = 256) -> DataFrame:
    """mm, max_prob, mean_prob, cells of each wanted rainfall, from its raster below `folder`.

    A raster whose manifest is there is only read; a missing one is computed from prob (r, c, prob) and written first.  The
    manifest is written last, so a job that was cut off is run again."""
    out = None
    for mm, cells in prob.items():
        path = f"{folder}/flood_{mm}mm"
        if not raster.exists(path):
            raster.write_raster(cells, path, ["prob"], transform, epsg, dtype="float64", sheet=sheet, block=block)
        found = raster.read_raster(spark, path, "prob").agg(F.max("prob").alias("max_prob"), F.avg("prob").alias("mean_prob"), F.count("prob").alias("cells"))
        one = found.select(F.lit(mm).alias("mm"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def bounds(height: Column, width: Column, transform: tuple, to_degrees) -> list[Column]:
    """west, south, east, north of a grid, from its four corners; to_degrees(x, y) gives columns of longitude and latitude."""
    a, b, c, d, e, f = transform
    corners = [(r, k) for r in (F.lit(0), height) for k in (F.lit(0), width)]
    lon, lat = zip(*(to_degrees(a * k + b * r + c, d * k + e * r + f) for r, k in corners))
    return [F.least(*lon).alias("west"), F.least(*lat).alias("south"), F.greatest(*lon).alias("east"), F.greatest(*lat).alias("north")]


def overlay(cells: DataFrame, transform: tuple, to_degrees, band: str = "prob", most: int = 1024) -> DataFrame:
    """One row: height, width, coloured (cells that are not transparent), west, south, east, north, image.

    The image is the PNG of an overview of at most `most` cells a side, as base64; only that bounded overview comes to the
    driver.  The bounds are those of the whole grid."""
    small = align.overview(cells.select("r", "c", band), most, [band])
    colours = small.select(F.col("r").alias("row"), F.col("c").alias("col"), *fn.colormap(F.col(band)))
    image = base64.b64encode(tiles.overlay_png(colours, most)).decode()
    size = cells.agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    counted = colours.agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.count_if(F.col("a") > 0).alias("coloured"))
    return counted.crossJoin(F.broadcast(size)).select("height", "width", "coloured", *bounds(F.col("_h"), F.col("_w"), transform, to_degrees), F.lit(image).alias("image"))


def first_hits(names: DataFrame, needles: DataFrame) -> DataFrame:
    """needle, name, ordinal: for each needle the name of smallest ordinal that holds it, whatever the case; NULL without
    one.  names (ordinal, name) are read once, and only the best hit of a needle in each partition is shuffled."""
    asked = needles.select("needle", F.lower(F.trim("needle")).alias("_q")).distinct()
    small = F.broadcast(asked) if asked.limit(BROADCAST_NEEDLES + 1).count() <= BROADCAST_NEEDLES else asked
    hits = names.select("ordinal", "name").join(small, F.contains(F.lower("name"), F.col("_q")))
    best = hits.groupBy("needle").agg(F.min(F.struct("ordinal", "name")).alias("b"))
    return asked.select("needle").join(best, "needle", "left").select("needle", F.col("b.name").alias("name"), F.col("b.ordinal").alias("ordinal"))
