"""Resampling and stacking read every row of the grid, also beyond row 99."""

from terracell.plans import catalog
from terracell.sources.grid import grid

SF = "/root/testdata/sf0.1"


def test_whole_grid_is_read(spark):
    n, last = grid(spark, SF).count(), grid(spark, SF).agg({"r": "max"}).collect()[0][0]
    assert last > 99 and catalog.queries()["band_stack_all"](spark, SF).count() == n
    for name in ("resample_nearest_all", "resample_bilinear_all"):
        rows = catalog.queries()[name](spark, SF).selectExpr("max(r)", "max(c)").collect()[0]
        assert (rows[0] + 1) * 1.7 >= last + 1 and (rows[1] + 1) * 1.7 >= 100
