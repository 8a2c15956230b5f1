"""Raster files as tables: the data source `raster` reads and writes TIFF files of one grid.

Written, a grid is a folder of sheets, one file for each square of `sheet` cells, so that tasks write side by side; a task
holds the compressed blocks of one sheet.  Files get names of their own attempt, and the manifest that commit() writes names
those of successful attempts with their place in the grid; others are never read.

Read, a folder is planned from its manifest and a single file from its size: sheets outside the window are not opened, and
each partition takes a slice of a file's blocks, about `partition_bytes` of it.  The task reads the tags and then only the
blocks that its slice and the window share.  Columns are r, c and one for each wanted band; nodata and NaN are NULL.

Paths are opened through pyarrow's file systems (file, hdfs, s3, ...).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from . import tiff

MANIFEST = "_sheets.json"
FAR = 1 << 40


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    """Whether a grid was written there to its end."""
    files, root = _open(path)
    return files.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File


def header_of(files: pafs.FileSystem, name: str) -> tiff.Raster:
    with files.open_input_file(name) as f:
        return tiff.read_header(lambda at, n: f.read_at(n, at))


class _Slice(InputPartition):
    def __init__(self, name: str, part: int, parts: int, r0: int, c0: int):
        self.name, self.part, self.parts, self.r0, self.c0 = name, part, parts, r0, c0


class RasterReader(DataSourceReader):
    def __init__(self, path: str, bands: list[tuple[int, str]], window: list[list[int]], partition_bytes: int):
        self.path, self.bands, self.window, self.partition_bytes = path, bands, window, partition_bytes

    def _sheets(self) -> Iterator[tuple[str, int, int, int]]:
        """name, bytes, first row and column of the files that the window meets."""
        files, root = _open(self.path)
        info = files.get_file_info(root)
        if info.type == pafs.FileType.File:
            yield root, info.size, 0, 0
            return
        with files.open_input_stream(f"{root}/{MANIFEST}") as f:
            sheets = json.loads(f.read())
        (r0, r1), (c0, c1) = self.window
        for s in sheets:
            if s["r"] < r1 and s["r"] + s["height"] > r0 and s["c"] < c1 and s["c"] + s["width"] > c0:
                yield f"{root}/{s['name']}", s["bytes"], s["r"], s["c"]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for name, size, r, c in self._sheets():
            parts = max(1, -(-size // self.partition_bytes))
            out += [_Slice(name, k, parts, r, c) for k in range(parts)]
        return out or [_Slice("", 0, 1, 0, 0)]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, _ = _open(self.path)
        with files.open_input_file(partition.name) as f:
            x = tiff.read_header(lambda at, n: f.read_at(n, at))
            if max(k for k, _ in self.bands) >= x.bands:
                raise ValueError(f"{partition.name} has {x.bands} bands")
            n = len(x.offsets)
            for k in range(partition.part * n // partition.parts, (partition.part + 1) * n // partition.parts):
                r, c, rows, cols = x.place(k)
                r, c = r + partition.r0, c + partition.c0
                (r0, r1), (c0, c1) = self.window
                if r >= r1 or r + rows <= r0 or c >= c1 or c + cols <= c0:
                    continue
                values = x.values(k, f.read_at(x.counts[k], x.offsets[k]) if x.counts[k] else b"")
                rr, cc = (a.ravel() for a in np.mgrid[r : r + rows, c : c + cols])
                own = (rr >= r0) & (rr < r1) & (cc >= c0) & (cc < c1)
                columns = [pa.array(rr[own], pa.int32()), pa.array(cc[own], pa.int32())]
                for band, _ in self.bands:
                    v = values[:, :, band].ravel()[own].astype(np.float64)
                    gone = np.isnan(v) if x.nodata is None else np.isnan(v) | (v == x.nodata)
                    columns.append(pa.array(v, mask=gone))
                yield pa.RecordBatch.from_arrays(columns, ["r", "c", *(name for _, name in self.bands)])


class PushingReader(RasterReader):
    """A reader that takes filters; Spark calls it only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons of r and c narrow the window; Spark checks all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) in (("r",), ("c",)) and isinstance(getattr(f, "value", None), int):
                low, high = {EqualTo: (f.value, f.value + 1), GreaterThan: (f.value + 1, FAR), GreaterThanOrEqual: (f.value, FAR), LessThan: (-FAR, f.value), LessThanOrEqual: (-FAR, f.value + 1)}.get(type(f), (-FAR, FAR))
                own = self.window[f.attribute == ("c",)]
                own[:] = max(own[0], low), min(own[1], high)
            yield f


class _Sheets(WriterCommitMessage):
    def __init__(self, sheets: list[dict]):
        self.sheets = sheets


class RasterWriter(DataSourceArrowWriter):
    """Rows (sheet_r, sheet_c, block, r, c, bands...) sorted by sheet and block."""

    def __init__(self, path: str, options: dict, bands: list[str]):
        self.path, self.o, self.bands = path, options, bands

    def _blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list]]:
        """(sheet_r, sheet_c, block) and the parts of its rows."""
        now, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy() for k in ("sheet_r", "sheet_c", "block")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for s, e in zip([0, *cuts], [*cuts, b.num_rows]):
                own = tuple(int(v) for v in key[:, s])
                if own != now and now is not None:
                    yield now, parts
                    parts = []
                now = own
                parts.append(b.slice(s, e - s))
        if now is not None:
            yield now, parts

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        side, how, dtype, nodata = int(self.o["block"]), tiff.NAMES[self.o["compression"]], np.dtype(self.o["dtype"]).newbyteorder("<"), float(self.o["nodata"])
        done, held, now = [], {}, None
        for (sr, sc, block), parts in self._blocks(iterator):
            if now not in (None, (sr, sc)):
                done.append(self._sheet(files, root, now, held))
                held = {}
            now = sr, sc
            x = np.full((side, side, len(self.bands)), nodata)
            for p in parts:
                at = p.column("r").to_numpy() % int(self.o["sheet"]) % side, p.column("c").to_numpy() % int(self.o["sheet"]) % side
                for k, name in enumerate(self.bands):
                    v = p.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
                    x[(*at, k)] = np.where(np.isnan(v), nodata, v)
            held[block] = tiff.compress(x.astype(dtype).tobytes(), how)
        if now is not None:
            done.append(self._sheet(files, root, now, held))
        return _Sheets(done)

    def _sheet(self, files: pafs.FileSystem, root: str, place: tuple[int, int], blocks: dict[int, bytes]) -> dict:
        side, (height, width) = int(self.o["sheet"]), (int(self.o[k]) for k in ("height", "width"))
        r, c = place[0] * side, place[1] * side
        rows, cols = min(side, height - r), min(side, width - c)
        transform = None
        if self.o.get("transform"):
            a, b, x, d, e, y = json.loads(self.o["transform"])
            transform = (a, b, x + a * c + b * r, d, e, y + d * c + e * r)
        data = tiff.file_of(cols, rows, len(self.bands), self.o["dtype"], tiff.NAMES[self.o["compression"]], int(self.o["block"]), blocks, transform, float(self.o["nodata"]), int(self.o["epsg"]) if self.o.get("epsg") else None)
        name = f"sheet_{place[0]}_{place[1]}-{uuid.uuid4().hex}.tif"  # an attempt never meets another one's file
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(data)
        return {"name": name, "bytes": len(data), "r": r, "c": c, "height": rows, "width": cols}

    def commit(self, messages: list) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        sheets = sorted((s for m in messages if m for s in m.sheets), key=lambda s: (s["r"], s["c"]))
        with files.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(sheets).encode())

    def abort(self, messages: list) -> None:
        files, root = _open(self.path)
        for s in (s for m in messages if m for s in m.sheets):
            files.delete_file(f"{root}/{s['name']}")


class RasterSource(DataSource):
    """Options: path, bands (names, comma-separated; the first bands of the file), or columns `name=number` of bands from 0,
    rows and cols (first:past) and partition_bytes; for writing see write_raster."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def _bands(self) -> list[tuple[int, str]]:
        parts = [x.partition("=") for x in self.options.get("bands", "value").split(",")]
        return [(int(number) if number else k, name.strip()) for k, (name, _, number) in enumerate(parts)]

    def schema(self) -> str:
        return ", ".join(["r int", "c int", *(f"{name} double" for _, name in self._bands())])

    def reader(self, schema) -> RasterReader:
        span = lambda x: [int(v) if v else other for v, other in zip(self.options.get(x, ":").split(":"), (-FAR, FAR))]
        kind = PushingReader if self.options.get("pushdown") == "true" else RasterReader
        return kind(self.options["path"], self._bands(), [span("rows"), span("cols")], int(self.options.get("partition_bytes", 8 << 20)))

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        fixed = ("sheet_r", "sheet_c", "block", "r", "c")
        return RasterWriter(self.options["path"], dict(self.options), [f.name for f in schema.fields if f.name not in fixed])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)


def read_raster(spark: SparkSession, path: str, bands: str = "value", rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, partition_bytes: int = 8 << 20) -> DataFrame:
    """r, c and the bands of a file or folder, inside rows[0] <= r < rows[1] and cols[0] <= c < cols[1]."""
    register(spark)
    reader = spark.read.format("raster").option("path", path).option("bands", bands).option("partition_bytes", partition_bytes)
    reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, span in (("rows", rows), ("cols", cols)):
        if span:
            reader = reader.option(name, f"{span[0]}:{span[1]}")
    return reader.load()


def write_raster(
    cells: DataFrame, path: str, bands: list[str], transform: tiff.Transform | None = None, epsg: int | None = None, nodata: float = -9999.0, dtype: str = "float32", compression: str = "lzw", block: int = 256, sheet: int = 4096
) -> None:
    """cells (r, c, bands...) as sheets below path.  Missing cells and NULLs become nodata; a sheet is a multiple of blocks."""
    if sheet % block or block % 16:
        raise ValueError("a block is a multiple of 16 cells, a sheet one of blocks")
    height, width = cells.agg(F.max("r") + 1, F.max("c") + 1).first()  # one row
    inside = lambda x: F.floor(F.pmod(F.col(x), F.lit(sheet)) / block)
    across = F.ceil(F.least(F.lit(sheet), F.lit(width or 0) - F.col("sheet_c") * sheet) / block)
    placed = cells.select(F.floor(F.col("r") / sheet).cast("int").alias("sheet_r"), F.floor(F.col("c") / sheet).cast("int").alias("sheet_c"), "r", "c", *[F.col(b).cast("double").alias(b) for b in bands])
    placed = placed.select("sheet_r", "sheet_c", (inside("r") * across + inside("c")).cast("int").alias("block"), "r", "c", *bands)
    ordered = placed.repartition("sheet_r", "sheet_c").sortWithinPartitions("sheet_r", "sheet_c", "block")
    register(cells.sparkSession)
    options = {"height": height or 0, "width": width or 0, "nodata": nodata, "dtype": dtype, "compression": compression, "block": block, "sheet": sheet}
    options |= ({"transform": json.dumps(transform)} if transform else {}) | ({"epsg": epsg} if epsg else {})
    ordered.write.format("raster").options(**options).mode("append").save(path)


def raster_catalog(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """One row for each file below a folder, from its tags alone: name, size, bands, dtype, compression, blocks, nodata,
    EPSG code and transform."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    numbers = ["width", "height", "bands", "block_rows", "block_cols", "blocks"]
    schema = f"path string, bytes long, {', '.join(f'{n} int' for n in numbers)}, dtype string, compression int, nodata double, epsg int, transform array<double>"

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, size in zip(b.column("path").to_pylist(), b.column("bytes").to_pylist()):
                fs, name = _open(path)
                x = header_of(fs, name)
                rows.append({"path": path, "bytes": size, **dict(zip(numbers, (x.width, x.height, x.bands, *x.block, len(x.offsets)))), "dtype": x.dtype.name, "compression": x.compression, "nodata": x.nodata, "epsg": x.epsg, "transform": list(x.transform) if x.transform else None})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("bytes", pa.int64()), *((n, pa.int32()) for n in numbers), ("dtype", pa.string()), ("compression", pa.int32()), ("nodata", pa.float64()), ("epsg", pa.int32()), ("transform", pa.list_(pa.float64()))]))

    return files.mapInArrow(tags, schema)
