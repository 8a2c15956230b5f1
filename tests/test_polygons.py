"""Scan conversion against the ray through every cell's centre."""

import numpy as np

from terracell.operators import polygons

RNG = np.random.default_rng(12)
RINGS = "feature int, ring int, point int, x double, y double"


def brute(rings, h, w):
    out = set()
    for f in {k[0] for k in rings}:
        for r in range(h):
            for c in range(w):
                odd = False
                for (g, _), points in rings.items():
                    if g != f:
                        continue
                    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1]):
                        if (y0 > r + 0.5) != (y1 > r + 0.5) and c + 0.5 < (x1 - x0) * (r + 0.5 - y0) / (y1 - y0) + x0:
                            odd = not odd
                if odd:
                    out.add((f, r, c))
    return out


def frame(spark, rings):
    return spark.createDataFrame([(f, k, i, float(x), float(y)) for (f, k), points in rings.items() for i, (x, y) in enumerate(points)], RINGS)


def test_random_rings_holes_and_parts(spark):
    h, w = 23, 31
    rings = {(f, k): [tuple(RNG.uniform(-4, 34, 2)) for _ in range(RNG.integers(3, 8))] for f in range(5) for k in range(3)}
    rings |= {(9, 0): [(2, 2), (20, 2), (20, 15), (2, 15)], (9, 1): [(5, 5), (9, 5), (9, 9), (5, 9)]}  # corners on cell borders, a hole
    rings |= {(10, 0): [(2.5, 2.5), (8.5, 2.5), (8.5, 8.5), (2.5, 8.5), (2.5, 2.5)]}  # closed, through centres
    cells = spark.range(h * w).selectExpr(f"int(id / {w}) AS r", f"int(id % {w}) AS c", "id AS v")
    want = brute(rings, h, w)
    for most in (1_000_000, 3):  # broadcast, and by shuffle
        got = [(x["feature"], x["r"], x["c"]) for x in polygons.inside(cells, frame(spark, rings), most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    hole = {(r, c) for f, r, c in want if f == 9}
    assert len(hole) == 18 * 13 - 16 and (6, 6) not in hole


def test_no_loop_over_edges_in_the_plan(spark):
    """Cells meet intervals of their row; no expression grows with the ring."""
    ring = {(1, 0): [(10 + 8 * np.cos(a), 10 + 8 * np.sin(a)) for a in np.linspace(0, 6.2, 500)]}
    cells = spark.range(400).selectExpr("int(id / 20) AS r", "int(id % 20) AS c")
    out = polygons.inside(cells, frame(spark, ring))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan and "aggregate(" not in plan
    assert {(x["feature"], x["r"], x["c"]) for x in out.collect()} == brute(ring, 20, 20)


def test_odd_rings(spark):
    cells = spark.range(100).selectExpr("int(id / 10) AS r", "int(id % 10) AS c")
    flat = {(1, 0): [(1, 1), (5, 1), (3, 1)], (2, 0): [(1, 1)], (3, 0): [(1, 1), (4, 4)]}
    assert polygons.inside(cells, frame(spark, flat)).collect() == []
    assert polygons.inside(cells, frame(spark, {(1, 0): [(0, 0), (9, 0), (9, 9)]}).limit(0)).collect() == []
    holes = spark.createDataFrame([(1, 0, 0, 1.0, 1.0), (1, 0, 1, None, 3.0), (1, 0, 2, 5.0, 5.0)], RINGS)
    assert isinstance(polygons.inside(cells, holes).collect(), list)
    moved = polygons.to_cells(spark.createDataFrame([(1, 0, 0, 1060.0, 4910.0)], RINGS), (30, 0, 1000, 0, -30, 5000)).first()
    assert (moved["x"], moved["y"]) == (2.0, 3.0)
