"""Unit grids and numpy models of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions import columns as fn
from terracell.operators import align, focal, metrics, patches, ranks, risk, stats


def cells(spark, band, name="x"):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(band)]
    return spark.createDataFrame(rows, f"r int, c int, {name} double")


def back(df, name, shape):
    out = np.full(shape, np.nan)
    for x in df.select("r", "c", name).collect():
        if x[name] is not None:
            out[x["r"], x["c"]] = x[name]
    return out


@pytest.mark.parametrize("shape,size", [((5, 7), 3), ((6, 6), 5), ((12, 9), 11)])
def test_box_mean_is_symmetric_padding(spark, shape, size):
    rng = np.random.default_rng(1)
    a = rng.normal(size=shape)
    got = back(focal.box_mean(cells(spark, a), {"m": F.col("x")}, size), "m", shape)
    h = size // 2
    p = np.pad(a, h, mode="symmetric")
    want = np.array([[p[i : i + size, j : j + size].mean() for j in range(shape[1])] for i in range(shape[0])])
    assert np.allclose(got, want)


def test_box_mean_leaves_out_nulls(spark):
    a = np.full((6, 6), np.nan)
    a[2:4, 2:4] = 3.0
    got = back(focal.box_mean(cells(spark, a), {"m": F.col("x")}, 3), "m", (6, 6))
    assert np.isnan(got[0, 0]) and got[1, 1] == 3.0 and np.isnan(got[5]).all()


def test_distance_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    a = (rng.random((15, 19)) < 0.06).astype(float)
    got = back(focal.nearest_feature(cells(spark, a), F.col("x") == 1), "distance", a.shape)
    f = np.argwhere(a == 1)
    want = np.array([[np.sqrt(((f - [i, j]) ** 2).sum(axis=1).min()) for j in range(19)] for i in range(15)])
    assert np.allclose(got, want)
    none = focal.nearest_feature(cells(spark, np.zeros((4, 4))), F.col("x") == 1)
    assert none.filter("distance IS NOT NULL OR near_r IS NOT NULL").count() == 0


def test_distance_ties_on_random_grids(spark):
    rng = np.random.default_rng(5)
    for h, w, share in ((9, 31, 0.03), (14, 14, 0.2), (3, 40, 0.5), (1, 25, 0.1), (25, 1, 0.2)):
        a = (rng.random((h, w)) < share).astype(float)
        a[h // 2, w // 2] = 1
        at = [(int(r), int(c)) for r, c in zip(*np.nonzero(a))]
        for x in focal.nearest_feature(cells(spark, a), F.col("x") == 1).collect():
            want = min(((x.r - r) ** 2 + (x.c - c) ** 2, r, c) for r, c in at)
            assert (x.near_r, x.near_c) == want[1:] and abs(x.distance - want[0] ** 0.5) < 1e-12


def test_coarse_height_above_drainage(spark):
    dem = np.arange(12 * 16, dtype=float).reshape(12, 16)
    got = back(focal.height_above_drainage_coarse(cells(spark, dem, "dem"), F.col("c") == 0), "hand", dem.shape)
    rows, cols = [0, 6, 11], [0, 5, 10, 15]
    coarse = dem[np.ix_(rows, cols)] - dem[rows, 0][:, None]
    y, x = np.arange(12) * 2 / 11, np.arange(16) * 3 / 15
    lines = np.array([np.interp(x, range(4), k) for k in coarse])
    assert np.allclose(got, np.array([np.interp(y, range(3), k) for k in lines.T]).T)
    assert {r.hand for r in focal.height_above_drainage_coarse(cells(spark, dem, "dem"), F.col("c") < 0).collect()} == {None}
    assert {r.hand for r in focal.height_above_drainage_coarse(cells(spark, dem[:3], "dem"), F.col("c") == 0).collect()} == {None}


def test_height_above_drainage(spark):
    dem = np.add.outer(np.arange(6.0) * 2, np.arange(6.0))
    got = back(focal.height_above_drainage(cells(spark, dem, "dem"), F.col("c") == 0), "hand", dem.shape)
    assert np.allclose(got, np.tile(np.arange(6.0), (6, 1)))


def test_resampling_to_the_same_grid_is_the_identity(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(5, 7))
    a[1, 2] = np.nan
    df = cells(spark, a)
    target = df.select("r", "c")
    for got in (align.resample_nearest(df, target, F.col("r") + 0.5, F.col("c") + 0.5, ["x"]), align.resample_bilinear(df, target, F.col("r") + 0.5, F.col("c") + 0.5, "x")):
        assert np.allclose(back(got, "x", a.shape), a, equal_nan=True)


def test_utm_round_trip_and_cells(spark):
    df = spark.createDataFrame([(76.28, 9.98), (75.0, 0.0), (77.5, 40.0)], "lon double, lat double")
    x, y = fn.to_utm(F.col("lon"), F.col("lat"))
    lon, lat = fn.from_utm(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9
        if r["lon"] == 75.0:
            assert abs(r["x"] - 500000) < 1e-6 and abs(r["y"]) < 1e-6
    t = (30.0, 0.0, 1000.0, 0.0, -30.0, 5000.0)
    row, col = fn.cell_of(F.lit(1061.0), F.lit(4999.0), t)
    x, y = fn.corner_of(row, col, t)
    assert tuple(spark.range(1).select(row, col, x, y).first()) == (0, 2, 1060.0, 5000.0)


def test_bounds_nulls_and_nan(spark):
    df = spark.createDataFrame([(0.0,), (0.10,), (0.12,), (0.2,), (0.25,), (0.3,), (0.5,), (1.0,), (None,), (float("nan"),), (-9999.0,)], "p double")
    out = [r[0] for r in df.select(fn.ladder(F.col("p"), "api")).limit(9).collect()]
    assert out == ["Safe", "Moderate", "Moderate", "Moderate", "High", "High", "Critical", "Critical", None]
    assert [r[0] for r in df.select(fn.clip(fn.to_null(F.col("p"), below=-9000), 0.1, 0.4)).collect()] == [0.1, 0.1, 0.12, 0.2, 0.25, 0.3, 0.4, 0.4, None, None, None]
    assert [r[0] for r in df.select(fn.ladder(F.lit(0.4), "hotspot")).limit(1).collect()] == ["Low"]
    assert df.select(fn.nearest_scenario(F.lit(125))).first()[0] == 100


def test_constant_and_missing_bands(spark):
    flat, gone = cells(spark, np.full((4, 4), 5.0)), cells(spark, np.full((4, 4), np.nan))
    assert {r["y"] for r in stats.minmax_or_zero(flat, "x", "y").collect()} == {0.0}
    assert {r["y"] for r in stats.robust(gone, "x", "y").collect()} == {0.0}
    assert stats.histogram(gone, "x").count() == 0 and stats.histogram(flat, "x").first()["n"] == 16


def test_metrics_against_pair_counting(spark):
    rng = np.random.default_rng(4)
    p, t = np.round(rng.random(300), 2), (rng.random(300) < 0.3).astype(float)
    p[:2] = [0.0, 1.0]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, t)], "pred double, target double")
    pos, neg = p[t == 1], p[t == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(metrics.areas(df).first()["auc"] - auc) < 1e-12
    c = metrics.confusion(df).first()
    assert sum(c) == 300
    assert metrics.calibration(df).agg(F.sum("n")).first()[0] == (p < 1).sum()
    one = df.filter("target = 0")
    assert metrics.areas(one).first()["auc"] == 0.0 and metrics.rates(metrics.confusion(one.filter("pred < 0.5"))).first()["iou"] == 1.0


def test_patches(spark):
    a = np.arange(70.0).reshape(7, 10)
    n = patches.sliding(cells(spark, a), 4, 2).groupBy("pr", "pc").count().collect()
    assert len(n) == 2 * 4 and {r["count"] for r in n} == {16}
    assert patches.sliding(cells(spark, a), 4, 3, partial=True).select("r", "c").distinct().count() == 70
    tiles = patches.tiled(cells(spark, a), 2).groupBy("pr", "pc").agg((F.max("x") > 60).alias("pos"))
    kept = patches.balance(tiles, F.col("pos"), times=1).collect()
    assert sum(r["pos"] for r in kept) * 2 == len(kept)


def test_hybrid_is_never_below_the_map(spark):
    df = spark.createDataFrame([(0.2, 0.3, 0.4, 0.9), (0.5, 0.5, 0.5, 0.0), (None, None, None, 0.9)], "p100 double, p150 double, p200 double, hydro double")
    for mm in (0, 50, 100, 125, 200, 400):
        a, b, c = [r["prob"] for r in risk.at_rainfall(df, mm).collect()]
        plain = [r[0] for r in df.select(fn.rainfall_interpolation(F.lit(float(mm)), F.col("p100"), F.col("p150"), F.col("p200"))).collect()]
        assert plain[0] <= a <= 1 and plain[1] <= b <= 1 and c is None


def test_running_totals_over_many_ranges(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.round(rng.normal(size=900), 2), np.full(300, 0.5)])  # one value in a quarter of the rows
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    counted = df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    for row in ranks.running_totals(counted, "x", ["n"], buckets=16).collect():
        assert row["n_to"] == (x <= row["x"]).sum()
    assert ranks.running_totals(counted.filter("n < 0"), "x", ["n"]).count() == 0
    holes = counted.union(spark.createDataFrame([(None, 5)], "x double, n long"))
    assert {r["n_to"] - (0 if r["x"] is None else (x <= r["x"]).sum()) for r in ranks.running_totals(holes, "x", ["n"]).collect()} == {5}


def test_percentiles_at_every_bound(spark):
    """The same values whatever the sketch's accuracy and the bound on what is held, so that every kind of pass is taken."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), np.arange(500) * 0.01])
    df = spark.createDataFrame([(float(v), "a") for v in x] + [(7.0, "b"), (None, "b"), (float("nan"), "a")], "x double, band string")
    bands = {"a": F.when(F.col("band") == "a", F.col("x")), "b": F.when(F.col("band") == "b", F.col("x")), "none": F.lit(None).cast("double")}
    wanted = {"lo": ("a", 0.013), "mid": ("a", 0.5), "flat": ("a", 0.62), "end": ("a", 1.0), "start": ("a", 0.0), "one": ("b", 0.9), "gone": ("none", 0.5)}
    for accuracy, held in ((10_000, 200_000), (50, 200_000), (50, 40), (20, 1)):
        got = ranks.percentiles(df, bands, wanted, accuracy, held)
        assert np.allclose([got[n] for n in ("lo", "mid", "flat", "end", "start")], np.quantile(x, [0.013, 0.5, 0.62, 1.0, 0.0])) and got["one"] == 7.0 and got["gone"] is None
    ends = spark.createDataFrame([(v,) for v in (float("-inf"), float("-inf"), 1.0, 2.0, float("inf"))], "x double")
    assert ranks.percentiles(ends, {"x": F.col("x")}, {"a": ("x", 0.0), "b": ("x", 0.5), "c": ("x", 1.0)}) == {"a": float("-inf"), "b": 1.0, "c": float("inf")}
    row = ranks.percentile_row(df, bands, wanted).first()
    assert row["mid"] == got["mid"] and row["gone"] is None
    assert ranks.with_percentiles(df, _p=(bands["a"], 0.5)).select("_p").distinct().collect() == [(got["mid"],)]


def test_percentiles_add_no_join_or_exchange(spark):
    df = spark.range(1000).selectExpr("double(id) AS x")
    plan = ranks.with_percentiles(df, _p=(F.col("x"), 0.99))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_bracket_that_misses_is_opened(spark):
    """Brackets far from their ranks are found out by the exact counts."""
    df = spark.range(5000).selectExpr("double(id) AS x")
    bracket = {"p": (10.0, 20.0)}
    ranks._narrow(df, {"p": F.col("x")}, {"p": 4000.0}, bracket, {"p"}, 100)
    assert bracket["p"][0] <= 4000 <= bracket["p"][1] and bracket["p"][1] - bracket["p"][0] < 500


def test_balance_needs_a_positive_patch(spark):
    tiles = spark.createDataFrame([(k, 0, False) for k in range(5)], "pr int, pc int, pos boolean")
    assert patches.balance(tiles, F.col("pos"), need_positive=False).count() == 0
    with pytest.raises(Exception, match="no positive patches"):
        patches.balance(tiles, F.col("pos")).collect()
