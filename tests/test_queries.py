"""Every registered query with a SQL twin gives the same rows as DuckDB, on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from terracell.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect(config={"threads": 2})
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.8g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = db.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = sorted(([plain(row[names.index(k)]) for k in cols] for row in found.fetchall()), key=str)
    assert sorted(([plain(r[k]) for k in cols] for r in df.collect()), key=str) == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:2] == ["n", "safe"]
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_nothing_outside_llm_imports_it():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/terracell/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "terracell.llm" not in open(path).read() and ".llm" not in open(path).read(), path
