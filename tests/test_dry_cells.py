"""Cells where nothing flows: a logarithm of 0 is minus infinity, in the queries as in their SQL."""

import glob
import os

import duckdb
import pytest

from terracell.plans import catalog
from tests.test_queries import SF, plain

NAMES = [
    "hydro_composite",
    "evacuation_zone",
    "forecast_risk",
    "rainfall_comparison",
    "rainfall_risk",
    "risk_alert",
    "risk_at_rainfall",
    "risk_views",
]


@pytest.fixture(scope="module")
def dry(tmp_path_factory):
    """The smallest tables, with no flow in every 97th cell."""
    folder = tmp_path_factory.mktemp("dry")
    for p in glob.glob(f"{SF}/*.parquet"):
        os.symlink(p, folder / os.path.basename(p))
    (folder / "events.parquet").unlink()
    c = duckdb.connect()
    c.execute(f"copy (select * replace (CASE WHEN event_id % 97 = 5 THEN 0 ELSE value END AS value) from '{SF}/events.parquet') to '{folder}/events.parquet' (format parquet)")
    for p in folder.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    assert c.execute("select count(*) from events where value = 0").fetchone()[0] > 5
    return str(folder), c


@pytest.mark.parametrize("name", NAMES)
def test_dry_cells_as_in_sql(spark, dry, name):
    folder, db = dry
    df = catalog.queries()[name](spark, folder)
    cols = sorted(df.columns)
    found = db.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    want = sorted(([plain(row[names.index(k)]) for k in cols] for row in found.fetchall()), key=str)
    assert sorted(([plain(r[k]) for k in cols] for r in df.collect()), key=str) == want
