"""Distances and heights from all features, against all pairs on the smallest grid."""

from terracell.plans import catalog
from terracell.sources.grid import grid

SF = "/root/testdata/sf0.001"


def test_nearest_of_all_features(spark):
    cells = grid(spark, SF).select("r", "c", "lulc", "flow", "dem").collect()
    far = lambda x, f: ((x.r - f.r) ** 2 + (x.c - f.c) ** 2, f.r, f.c)
    town, water = ([f for f in cells if f.lulc == k] for k in (50, 80))
    drained = [f for f in cells if f.flow is not None and f.flow > 33 and f.dem is not None]
    maps = {(r.r, r.c): (r.to_water, r.to_town) for r in catalog.queries()["distance_maps_all"](spark, SF).collect()}
    hand = {(r.r, r.c): (r.near_r, r.near_c, r.hand) for r in catalog.queries()["height_above_drainage_all"](spark, SF).collect()}
    assert len(maps) == len(hand) == len(cells)
    for x in cells:
        assert maps[x.r, x.c] == tuple(round(min(far(x, f) for f in fs)[0] ** 0.5 * 30.0, 6) for fs in (water, town))
        f = min(drained, key=lambda f: far(x, f))
        assert hand[x.r, x.c] == (f.r, f.c, None if x.dem is None else round(x.dem - f.dem, 6))
