"""Prediction jobs, overlays, searches, routing, zooms and orders."""

import base64
import glob
import hashlib
import json
import os
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from terracell.functions import columns as fn
from terracell.operators import align, jobs, metrics, patches
from terracell.sources import catalog, raster

RNG = np.random.default_rng(21)
METRES = (30.0, 0.0, 631480.0, 0.0, -30.0, 1116880.0)


def grid_of(spark, x, name="prob"):
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(x)], f"r int, c int, {name} double")


def test_predict_runs_only_what_is_missing(spark, tmp_path):
    x = RNG.random((20, 24))
    x[3, 3] = np.nan
    folder, prob = f"file://{tmp_path}", {100: grid_of(spark, x), 200: grid_of(spark, x / 2)}
    first = {r["mm"]: r for r in jobs.predict(spark, prob, folder, METRES, 32643, 32, 16).collect()}
    assert first[100]["cells"] == first[200]["cells"] == x.size - 1 and np.isclose(first[100]["max_prob"], np.nanmax(x)) and np.isclose(first[200]["mean_prob"], np.nanmean(x) / 2)
    # what is there is read, whatever the cells are now; what was cut off before its manifest is run again
    os.remove(tmp_path / "flood_200mm" / raster.MANIFEST)
    other = {100: grid_of(spark, x * 0), 200: grid_of(spark, x * 0 + 0.25)}
    again = {r["mm"]: r for r in jobs.predict(spark, other, folder, METRES, 32643, 32, 16).collect()}
    assert np.isclose(again[100]["max_prob"], np.nanmax(x)) and again[200]["max_prob"] == 0.25 == again[200]["mean_prob"]
    assert len(json.loads((tmp_path / "flood_200mm" / raster.MANIFEST).read_text())) == 1 < len(glob.glob(f"{tmp_path}/flood_200mm/*.tif"))


def pixels(png):
    at, body, size = 8, b"", None
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        data = png[at + 8 : at + 8 + n]
        size = struct.unpack(">II", data[:8]) if kind == b"IHDR" else size
        body += data if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], 1 + 4 * size[0])[:, 1:].reshape(size[1], size[0], 4)


def test_overlay_image_and_bounds(spark):
    x = RNG.random((30, 44))
    x[:5, :5] = np.nan
    one = jobs.overlay(grid_of(spark, x), METRES, fn.from_utm, most=15).first()
    image = pixels(base64.b64decode(one["image"]))
    assert image.shape == (10, 15, 4) == (one["height"], one["width"], 4) and one["coloured"] == (image[:, :, 3] > 0).sum()
    means = np.array([[np.nanmean(x[3 * i : 3 * i + 3, 3 * j : 3 * j + 3]) if not np.isnan(x[3 * i : 3 * i + 3, 3 * j : 3 * j + 3]).all() else np.nan for j in range(15)] for i in range(10)])
    assert ((image[:, :, 3] > 0) == ~np.isnan(means)).all()
    want = spark.createDataFrame([(float(v),) for v in means[2]], "p double").select(*fn.colormap(F.col("p"))).collect()
    assert [tuple(int(v) for v in p) for p in image[2] if p[3]] == [(r["r"], r["g"], r["b"], r["a"]) for r in want if r["a"]]
    corners = [(631480.0 + 30 * c, 1116880.0 - 30 * r) for r in (0, 30) for c in (0, 44)]
    back = spark.createDataFrame(corners, "x double, y double").select(*[v.alias(n) for v, n in zip(fn.from_utm(F.col("x"), F.col("y")), ("lon", "lat"))]).collect()
    assert np.allclose([one["west"], one["east"]], [min(p["lon"] for p in back), max(p["lon"] for p in back)]) and np.allclose([one["south"], one["north"]], [min(p["lat"] for p in back), max(p["lat"] for p in back)])


def test_first_hits(spark):
    names = spark.createDataFrame([(3, "North Aluva"), (1, "aluva"), (2, "Kochi"), (4, None)], "ordinal int, name string")
    needles = spark.createDataFrame([(" ALU ",), ("kochi",), ("x",), ("kochi",), ("",)], "needle string")
    for most in (jobs.BROADCAST_NEEDLES, 1):
        jobs.BROADCAST_NEEDLES, kept = most, jobs.BROADCAST_NEEDLES
        got = {r["needle"]: (r["name"], r["ordinal"]) for r in jobs.first_hits(names, needles).collect()}
        jobs.BROADCAST_NEEDLES = kept
        assert got == {" ALU ": ("aluva", 1), "kochi": ("Kochi", 2), "x": (None, None), "": ("aluva", 1)}


def test_routing_takes_the_first_layer_of_a_role(spark):
    entries = spark.createDataFrame([("a", 2, "x", 1), ("a", 1, "z", 2), ("a", 1, "y", 3), ("b", 5, "w", 4), ("c", None, "v", 5)], "role string, priority int, path string, more int")
    assert {r["role"]: (r["path"], r["more"]) for r in catalog.resolved(entries).collect()} == {"a": ("y", 3), "b": ("w", 4), "c": ("v", 5)}
    assert catalog.resolved(entries).columns == entries.columns


def test_zoom_against_places(spark):
    x = RNG.random((9, 13))
    x[4, 4] = np.nan
    for factor in (0.5, 1.0, 2.3):
        h, w = round(9 * factor), round(13 * factor)
        near = {(r["r"], r["c"]): r["prob"] for r in align.zoom(grid_of(spark, x), "prob", factor, 0).collect()}
        line = {(r["r"], r["c"]): r["prob"] for r in align.zoom(grid_of(spark, x), "prob", factor, 1).collect()}
        assert len(near) == len(line) == h * w
        for r, c in near:
            y, z = r * 8 / (h - 1), c * 12 / (w - 1)
            v = x[int(np.floor(y + 0.5)), int(np.floor(z + 0.5))]
            assert (near[r, c] is None and np.isnan(v)) or near[r, c] == v
            total = weight = 0.0
            for i in (int(y), int(y) + 1):
                for j in (int(z), int(z) + 1):
                    t = (1 - abs(y - i)) * (1 - abs(z - j))
                    if t > 1e-12 and i < 9 and j < 13 and not np.isnan(x[i, j]):
                        total, weight = total + t * x[i, j], weight + t
            assert weight < 1e-9 or np.isclose(line[r, c], total / weight)
    assert align.zoom(grid_of(spark, x).limit(0), "prob", 2.0).collect() == []


def test_shuffled_is_an_order_of_its_own(spark):
    rows = spark.range(3000).selectExpr("int(id) AS pr", "int(id % 7) AS pc").repartition(5)
    got = {r["pr"]: r["place"] for r in patches.shuffled(rows, ["pr", "pc"], 3).collect()}
    order = sorted(range(3000), key=lambda k: hashlib.md5(f"3|{k}|{k % 7}".encode()).hexdigest())
    assert [got[k] for k in order] == list(range(3000))
    assert patches.shuffled(rows.coalesce(1), ["pr", "pc"], 4).filter("pr = place").count() < 20


def test_monotone_curves(spark):
    df = spark.createDataFrame([("a", [0.3, None, 0.1, 0.2]), ("b", []), ("c", None)], "k0 string, v array<double>")
    assert [tuple(r) for r in metrics.monotone(df, "k0", "v").collect()] == [("a", 0, 0.1), ("a", 1, 0.2), ("a", 2, 0.3)]
