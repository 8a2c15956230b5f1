"""Raster files: compression, tags, sheets, slices, windows; and reprojection."""

import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terracell.functions import columns as fn
from terracell.operators import align
from terracell.sources import raster, tiff
from terracell.sources.tiff import lzw_decode, lzw_encode

RNG = np.random.default_rng(8)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000))
def test_lzw_round_trip(data):
    assert lzw_decode(lzw_encode(data)) == data


def test_lzw_of_long_and_flat_data():
    """Tables that fill up and start anew, and all code widths."""
    for data in (RNG.integers(0, 256, 60_000).astype(np.uint8).tobytes(), b"\0" * 300_000, bytes(range(256)) * 400, b"ab" * 5000, RNG.integers(0, 3, 50_000).astype(np.uint8).tobytes()):
        coded = lzw_encode(data)
        assert lzw_decode(coded) == data
    assert len(lzw_encode(b"\0" * 300_000)) < 3000
    assert lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])  # clear 7 258 8 8 258 6 6 end, in 9 bits


def grid_of(spark, bands, start=(0, 0)):
    names = list(bands)
    h, w = bands[names[0]].shape
    rows = [(r + start[0], c + start[1], *(None if np.isnan(bands[n][r, c]) else float(bands[n][r, c]) for n in names)) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "r int, c int, " + ", ".join(f"{n} double" for n in names))


def back(df, names):
    return {(r["r"], r["c"]): tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("how,dtype", [("lzw", "float32"), ("deflate", "float64"), ("none", "int16")])
def test_sheets_round_trip(spark, tmp_path, how, dtype):
    a, b = RNG.integers(-500, 500, (70, 45)).astype(float), RNG.integers(0, 9, (70, 45)).astype(float)
    a[3, 4] = a[69, 44] = np.nan
    cells, path = grid_of(spark, {"a": a, "b": b}), f"file://{tmp_path}/r"
    raster.write_raster(cells, path, ["a", "b"], (30, 0, 1000, 0, -30, 5000), 32643, dtype=dtype, compression=how, block=16, sheet=32)
    assert back(raster.read_raster(spark, path, "a,b"), "ab") == back(cells, "ab")
    files = sorted(f for f in os.listdir(tmp_path / "r") if f.endswith(".tif"))
    assert len(files) == 6
    meta = {m["path"].split("/")[-1].split("-")[0]: m for m in raster.raster_catalog(spark, path).collect()}
    one = meta["sheet_2_1"]
    assert (one["height"], one["width"], one["bands"], one["nodata"], one["epsg"], one["dtype"]) == (6, 13, 2, -9999.0, 32643, dtype)
    assert one["transform"] == [30, 0, 1000 + 30 * 32, 0, -30, 5000 - 30 * 64]


def test_windows_open_only_what_they_need(spark, tmp_path):
    a = np.arange(64 * 64, dtype=float).reshape(64, 64)
    path = f"file://{tmp_path}/r"
    raster.write_raster(grid_of(spark, {"a": a}), path, ["a"], block=16, sheet=32, dtype="float64")
    reader = raster.RasterReader(path, [(0, "value")], [[0, 20], [33, 43]], 8 << 20)
    assert len(reader.partitions()) == 1 and "sheet_0_1" in reader.partitions()[0].name  # of four sheets
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) == 2 and sum(b.num_rows for b in batches) == 200  # two of its four blocks
    assert len(raster.RasterReader(path, [(0, "value")], [[0, 64], [0, 64]], 2000).partitions()) == sum(-(-os.path.getsize(tmp_path / "r" / f) // 2000) for f in os.listdir(tmp_path / "r") if f.endswith(".tif"))
    whole = raster.read_raster(spark, path, partition_bytes=2000)
    assert whole.rdd.getNumPartitions() > 4 and back(whole, ["value"]) == {k: (v,) for k, v in np.ndenumerate(a)}
    # what no attempt committed is not read
    (tmp_path / "r" / "sheet_9_9-lost.tif").write_bytes(b"broken")
    assert whole.count() == a.size
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    pushed = raster.PushingReader(path, [(0, "value")], [[-raster.FAR, raster.FAR], [-raster.FAR, raster.FAR]], 8 << 20)
    filters = [GreaterThan(("r",), 40), LessThanOrEqual(("c",), 7), EqualTo(("value",), 3.0)]
    assert list(pushed.pushFilters(filters)) == filters and pushed.window == [[41, raster.FAR], [-raster.FAR, 8]] and len(pushed.partitions()) == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert raster.read_raster(spark, path).filter("r > 40 AND c <= 7 AND value < 3000").count() == ((a[41:, :8]) < 3000).sum()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def strip_file(x, order=">", how=8, predictor=1, rows_per_strip=3):
    """A file of strips with another byte order, as other writers make them."""
    kind = np.dtype(x.dtype).newbyteorder(order)
    stored = np.diff(x, axis=1, prepend=0).astype(x.dtype) if predictor == 2 else x
    strips = [tiff.compress(stored[s : s + rows_per_strip].astype(kind).tobytes(), how) for s in range(0, len(x), rows_per_strip)]
    offsets, at = [], 8
    for s in strips:
        offsets.append(at)
        at += len(s)
    tags = [(256, 3, [x.shape[1]]), (257, 3, [x.shape[0]]), (258, 3, [kind.itemsize * 8]), (259, 3, [how]), (273, 4, offsets), (277, 3, [1]), (278, 3, [rows_per_strip]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]]), (42113, 2, b"7\0")]
    entries, further, end = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, code, v in tags:
        data = v if isinstance(v, bytes) else struct.pack(order + tiff.TYPES[code][0] * len(v), *v)
        own = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", end + len(further))
        further += data if len(data) > 4 else b""
        entries += struct.pack(order + "HHI", tag, code, len(v)) + own
    return (b"MM" if order == ">" else b"II") + struct.pack(order + "HI", 42, at) + b"".join(strips) + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + further


@pytest.mark.parametrize("order,how,predictor", [(">", 8, 1), ("<", 5, 2), (">", 1, 1)])
def test_strips_of_other_writers(spark, tmp_path, order, how, predictor):
    x = RNG.integers(0, 200, (10, 13)).astype(np.int32)
    (tmp_path / "x.tif").write_bytes(strip_file(x, order, how, predictor))
    got = back(raster.read_raster(spark, f"file://{tmp_path}/x.tif", rows=(2, 9)), ["value"])
    assert got == {(r, c): (None if x[r, c] == 7 else float(x[r, c]),) for r in range(2, 9) for c in range(13)}


def test_what_is_no_raster(spark, tmp_path):
    with pytest.raises(ValueError, match="TIFF"):
        tiff.read_header(lambda at, n: b"PK\x03\x04" + b"\0" * n)
    with pytest.raises(ValueError, match="compression"):
        tiff.decompress(b"", 7)
    with pytest.raises(ValueError, match="multiple"):
        raster.write_raster(spark.createDataFrame([], "r int, c int, a double"), f"file://{tmp_path}/x", ["a"], block=20)
    raster.write_raster(spark.createDataFrame([], "r int, c int, a double"), f"file://{tmp_path}/e", ["a"])
    assert raster.read_raster(spark, f"file://{tmp_path}/e").collect() == []
    assert zlib.decompress(tiff.compress(b"x", tiff.DEFLATE)) == b"x"


def test_reprojection_cell_by_cell(spark):
    """A turned and scaled grid with holes, tiles smaller than the grid, against one cell after the other."""
    a, k = RNG.normal(size=(23, 31)), RNG.integers(1, 9, (23, 31)).astype(float)
    a[4:7, 8:12] = np.nan
    k[20, 3] = np.nan
    from pyspark.sql import functions as F

    turn = np.radians(20)
    inverse = lambda x, y: (F.lit(np.cos(turn)) * x - F.lit(np.sin(turn)) * y, F.lit(np.sin(turn)) * x + F.lit(np.cos(turn)) * y)
    source, target, (h, w) = (2.0, 0.0, 5.0, 0.0, -2.0, 60.0), (1.3, 0.0, 20.0, 0.0, -1.3, 50.0), (37, 45)
    extent = spark.createDataFrame([(h, w)], "h int, w int")
    for tile in (8, 64):
        tiles = align.target_tiles(F.col("h"), F.col("w"), extent, tile)
        got = back(align.reproject(grid_of(spark, {"a": a, "k": k}), source, tiles, target, inverse, ["k"], ["a"], tile), "ak")
        assert len(got) == h * w
        seen = 0
        for (r, c), (va, vk) in got.items():
            x, y = 20 + 1.3 * (c + 0.5), 50 - 1.3 * (r + 0.5)
            x, y = np.cos(turn) * x - np.sin(turn) * y, np.sin(turn) * x + np.cos(turn) * y
            fy, fx = (60 - y) / 2, (x - 5) / 2
            at = int(np.floor(fy)), int(np.floor(fx))
            near = k[at] if 0 <= at[0] < 23 and 0 <= at[1] < 31 else np.nan
            assert (vk is None and np.isnan(near)) or vk == near
            total = weight = 0.0
            for i in (0, 1):
                for j in (0, 1):
                    p, q = int(np.floor(fy - 0.5)) + i, int(np.floor(fx - 0.5)) + j
                    if 0 <= p < 23 and 0 <= q < 31 and not np.isnan(a[p, q]):
                        t = (1 - abs(fy - 0.5 - p)) * (1 - abs(fx - 0.5 - q))
                        total, weight = total + t * a[p, q], weight + t
            assert (va is None and weight == 0) or np.isclose(va, total / weight)
            seen += va is not None
        assert 200 < seen < h * w


def test_the_same_grid_is_the_identity(spark):
    from pyspark.sql import functions as F

    a = RNG.normal(size=(9, 7))
    a[2, 2] = np.nan
    t = (30.0, 0.0, 631480.0, 0.0, -30.0, 1116880.0)
    tiles = align.target_tiles(F.lit(9), F.lit(7), spark.range(1), 4)
    got = back(align.reproject(grid_of(spark, {"a": a, "b": a}), t, tiles, t, lambda x, y: (x, y), ["a"], ["b"], 4), "ab")
    assert all((v[0] is None and np.isnan(x)) or (v[0] == x and np.isclose(v[1], x)) for (k, x), v in zip(np.ndenumerate(a), (got[k] for k in np.ndindex(a.shape))))
    assert align.reproject(grid_of(spark, {"a": a}).limit(0), t, align.target_tiles(F.lit(2), F.lit(2), spark.range(1), 4), t, lambda x, y: (x, y), ["a"], [], 4).collect() and fn.from_utm
