"""Directional filters, distances by bands of rows, kept patches and block reads."""

import glob

import numpy as np
from pyspark.sql import functions as F

from terracell.operators import focal, patches
from terracell.sources import tiles

RNG = np.random.default_rng(3)


def grid_of(spark, x):
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(x)], "r int, c int, v double")


def plain_refined_lee(x, looks):
    """One cell after the other, straight from the definition."""
    h, w = x.shape
    out = np.full(x.shape, np.nan)

    def values(places):
        return [x[a, b] for a, b in places if 0 <= a < h and 0 <= b < w and not np.isnan(x[a, b])]

    for r, c in np.ndindex(x.shape):
        if np.isnan(x[r, c]):
            continue
        mean = {}
        for i in (-2, 0, 2):
            for j in (-2, 0, 2):
                near = values([(r + i + a, c + j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
                mean[i, j] = np.mean(near) if near else None
        mean = {k: mean[0, 0] if v is None else v for k, v in mean.items()}
        # left, upper left, top, upper right: their three means against those across
        corners = [(-2, -2), (-2, 0), (-2, 2), (0, 2), (2, 2), (2, 0), (2, -2), (0, -2)]
        best = None
        for direction, at in enumerate((7, 0, 1, 2)):
            one, other = ([corners[(at + k + s) % 8] for k in (-1, 0, 1)] for s in (0, 4))
            gradient = abs(sum(mean[k] for k in one) - sum(mean[k] for k in other))
            if best is None or gradient > best[0] + 1e-12:
                near_other = abs(mean[corners[(at + 4) % 8]] - mean[0, 0]) < abs(mean[corners[at]] - mean[0, 0])
                best = gradient, corners[(at + 4) % 8] if near_other else corners[at]
        i, j = best[1]
        own = values([(r + a, c + b) for a in range(-3, 4) for b in range(-3, 4) if a * i + b * j >= 0])
        m, v = np.mean(own), np.var(own)
        k = max(v - m * m / looks, 0) / (1 + 1 / looks) / v if v > 1e-12 else 0.0
        out[r, c] = m + k * (x[r, c] - m)
    return out


def test_refined_lee_cell_by_cell(spark):
    x = np.abs(RNG.normal(10, 4, (17, 19)))
    x[:, 9:] += 30  # an edge
    x[5:8, 3:6] = x[0, 0] = x[16, 18] = x[12, 9] = np.nan
    want = plain_refined_lee(x, 3.0)
    assert np.allclose(focal.refined_lee_of(x, 3.0), want, equal_nan=True)
    for tile in (5, 64):
        got = {(r["r"], r["c"]): r["lee"] for r in focal.refined_lee(grid_of(spark, x), "v", 3.0, tile).collect()}
        assert len(got) == x.size
        for k, v in np.ndenumerate(want):
            assert (got[k] is None) == np.isnan(v) and (np.isnan(v) or np.isclose(got[k], v))


def test_refined_lee_keeps_edges_and_flat_ground(spark):
    flat = np.full((12, 12), 5.0)
    assert np.allclose(focal.refined_lee_of(flat, 4.0), 5.0)
    step = np.where(np.arange(16) < 8, 1.0, 100.0) * np.ones((16, 1))
    assert np.allclose(focal.refined_lee_of(step, 1.0)[:, [7, 8]], step[:, [7, 8]])
    assert focal.refined_lee(grid_of(spark, flat).limit(0), "v").collect() == []


def test_nearest_in_rows_against_all_sources():
    for _ in range(20):
        rows, x, row_of, at, g, owner, rank = int(RNG.integers(1, 6)), [], [], [], [], [], []
        for k in range(rows):
            places = np.flatnonzero(RNG.random(25) < 0.7)
            x += places.tolist()
            row_of += [k] * len(places)
            sources = np.flatnonzero(RNG.random(25) < RNG.choice([0.0, 0.2, 0.8]))
            at += sources.tolist()
            g += (RNG.integers(0, 6, len(sources)) ** 2).tolist()
            owner += [k] * len(sources)
        row_of, x, at, g, owner = (np.array(v, np.int64) for v in (row_of, x, at, g, owner))
        rank = RNG.permutation(len(at))
        # rows are numbered among those that have places, as in a band
        first = np.searchsorted(owner, np.arange(rows + 1))
        got = focal._nearest_in_rows(row_of, x, first[:-1], first[1:], at, g, rank)
        for k, (r, c) in enumerate(zip(row_of, x)):
            own = np.flatnonzero(owner == r)
            want = min(own, key=lambda s: (g[s] + (c - at[s]) ** 2, rank[s]), default=-1)
            assert got[k] == want


def test_distances_in_small_bands(spark, monkeypatch):
    monkeypatch.setattr(focal, "BAND", 7)  # less than a row
    x = np.where(RNG.random((23, 17)) < 0.06, 1.0, 0.0)
    x[4, 5] = np.nan
    cells = grid_of(spark, x).filter("NOT (r = 3 AND c BETWEEN 2 AND 9)")  # a row with a gap
    near = focal.nearest_features(cells, {"f": F.col("v") == 1, "none": F.col("v") == 9}, carry="v", cell=2.0)
    rows = near.collect()
    at = [(r, c) for (r, c), v in np.ndenumerate(x) if v == 1 and not (r == 3 and 2 <= c <= 9)]
    assert len(rows) == x.size - 8
    for row in rows:
        best = min(at, key=lambda f: ((row["r"] - f[0]) ** 2 + (row["c"] - f[1]) ** 2, f))
        assert (row["f_r"], row["f_c"], row["f_carried"]) == (*best, 1.0) and np.isclose(row["f_distance"], 2 * np.hypot(row["r"] - best[0], row["c"] - best[1]))
        assert row["none_distance"] is None and row["none_r"] is None
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_kept_patches_equal_the_flags(spark):
    x = RNG.random((33, 40))
    x[10, 10] = np.nan
    cells = grid_of(spark, x).withColumn("more", F.lit(1.0))
    wanted = F.col("all_valid") & (F.col("positives") > 20) & (F.col("peak") > 0.9)
    flags = patches.summary(patches.tiled(cells, 8), 8, "v", F.col("v") > 0.6).filter("whole AND all_valid AND positives > 20 AND peak > 0.9")
    want = {(p["pr"], p["pc"]) for p in flags.collect()}
    for most in (1000, 1):
        got = patches.kept(cells, 8, "v", F.col("v") > 0.6, wanted, most)
        rows = got.collect()
        assert {(r["pr"], r["pc"]) for r in rows} == want and len(rows) == 64 * len(want) and 0 < len(want) < 20
    # broadcast, the cells' own branch has no exchange: every exchange is below the table of patches
    plan = patches.kept(cells, 8, "v", F.col("v") > 0.6, wanted)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.index("LeftSemi") < plan.index("HashAggregate") and "SortMergeJoin" not in plan
    assert patches.kept(cells, 8, "v", F.col("v") > 2, F.col("positives") > 0).collect() == []


def test_only_wanted_blocks_are_opened(spark, tmp_path):
    """Other tiles' files are broken on purpose once the table is known."""
    x, path = RNG.random((32, 48)), str(tmp_path / "tiles")
    tiles.write_tiles(grid_of(spark, x), path, 8)
    wanted = spark.createDataFrame([(1, 2), (3, 5), (1, 2), (None, 1), (9, 9)], "tile_r int, tile_c int")
    out = tiles.read_blocks(spark, path, wanted)
    assert "dynamicpruning" in out._jdf.queryExecution().optimizedPlan().toString()
    files = glob.glob(f"{path}/tile_r=*/tile_c=*/*.parquet")
    assert len(files) == 24
    for name in files:
        if not any(f"tile_r={r}/tile_c={c}/" in name for r in (1, 3) for c in (2, 5)):  # rows and columns are pruned each for itself
            open(name, "wb").write(b"broken")
    got = {(r["r"], r["c"]): r["v"] for r in out.collect()}
    assert got == {(r, c): x[r, c] for r, c in np.ndindex(x.shape) if (r // 8, c // 8) in ((1, 2), (3, 5))}
