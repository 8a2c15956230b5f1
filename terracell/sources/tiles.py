"""Cell tables in files: tiles for pruning on the way in, sentinels and small images on the way out."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = -9999.0
#: Wanted blocks up to this many prune a read.
BROADCAST_BLOCKS = 200_000


def write_tiles(cells: DataFrame, path: str, side: int = 1024, compression: str = "zstd") -> None:
    """Parquet by tile, sorted by place in it; readers prune folders by tile and row groups by r and c."""
    tiled = cells.withColumn("tile_r", F.floor(F.col("r") / side).cast("int")).withColumn("tile_c", F.floor(F.col("c") / side).cast("int"))
    ordered = tiled.repartition("tile_r", "tile_c").sortWithinPartitions("tile_r", "tile_c", "r", "c")
    ordered.write.option("compression", compression).partitionBy("tile_r", "tile_c").parquet(path)


def unpivoted(cells: DataFrame, bands: list[str]) -> DataFrame:
    """band, r, c, value: one row for each band of a cell that has a value there."""
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in bands]))
    return cells.select("r", "c", each.alias("v")).select("v.band", "r", "c", "v.value").filter("value IS NOT NULL")


def write_bands(cells: DataFrame, path: str, bands: list[str]) -> None:
    """A folder of Parquet for each band, by ranges of rows, so that one band is read alone."""
    unpivoted(cells, bands).repartitionByRange("band", "r").write.partitionBy("band").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Small results (metrics, statistics) as JSON lines in one file."""
    rows.coalesce(1).write.json(path)


def read_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], side: int = 1024) -> DataFrame:
    """Cells with rows[0] <= r < rows[1] and cols[0] <= c < cols[1]."""
    own = lambda x, span: (F.col(f"tile_{x}").between(span[0] // side, (span[1] - 1) // side)) & (F.col(x) >= span[0]) & (F.col(x) < span[1])
    return spark.read.parquet(path).filter(own("r", rows) & own("c", cols)).drop("tile_r", "tile_c")


def read_blocks(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """The cells of the wanted blocks (tile_r, tile_c) of write_tiles.  Which folders are read is decided at run time, from
    the rows of `blocks` (dynamic partition pruning): the folders of tile rows, and of tile columns,
    that no wanted block lies in are not opened.  That needs the wanted blocks
    as a broadcast, of at most BROADCAST_BLOCKS (counted before); beyond them Spark joins by shuffle and reads all tiles."""
    wanted = blocks.select("tile_r", "tile_c").filter("tile_r >= 0 AND tile_c >= 0").distinct()  # Spark prunes only by a filtered table
    if wanted.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        wanted = F.broadcast(wanted)
    return spark.read.parquet(path).join(wanted, ["tile_r", "tile_c"])


def with_sentinel(x: Column) -> Column:
    return F.coalesce(x, F.lit(NODATA))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def overlay_png(colours: DataFrame, most: int = 1024) -> bytes:
    """A PNG of cells (row, col, r, g, b, a); the overview must fit most x most cells, which bounds what is collected."""
    height, width = colours.agg(F.max("row") + 1, F.max("col") + 1).first()
    if max(height or 0, width or 0) > most:
        raise ValueError(f"an overlay has at most {most} x {most} cells: take an overview first")
    image = [bytearray(4 * (width or 0)) for _ in range(height or 0)]
    for x in colours.select("row", "col", "r", "g", "b", "a").toLocalIterator():
        image[x["row"]][4 * x["col"] : 4 * x["col"] + 4] = bytes([x["r"], x["g"], x["b"], x["a"]])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width or 0, height or 0, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(x) for x in image))) + chunk(b"IEND", b"")


def as_json(rows: DataFrame) -> DataFrame:
    """One column `json`: the served form of small results."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def alert_link(one: DataFrame, to: str) -> DataFrame:
    """mailto: the alert of risk.alert as a link with an encoded body."""
    body = F.format_string("Level %s: %.1f %% of cells critical, %d people", "level", "critical_pct", "people")
    return one.select(F.concat(F.lit(f"mailto:{to}?subject=Flood%20alert&body="), F.replace(F.url_encode(body), F.lit("+"), F.lit("%20"))).alias("link"))
