import hashlib
import math
from collections import Counter

import duckdb
import pandas as pd

from terracell.llm.common import table
from terracell.llm.mixing import ORACLE_SQL, mix_sources, mixture, shuffled

SCHEMA = "doc_id long, text string, source string"


def draw(i, rate, seed=17):
    draws = max(1, math.ceil(rate / 16))
    total, mean = 0, rate / draws
    for j in range(1, draws + 1):
        tail = f"|{j}" if j > 1 else ""
        u = int(hashlib.md5(f"{seed}|{'' if i is None else i}{tail}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-mean)
        c = p
        while c <= u and n < 64:
            n += 1
            p *= mean / n
            c += p
        total += n if mean > 0 else 0
    return total


def test_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["source"]) for r in docs.collect()]
    n = Counter(s for _, s in rows)
    total = sum(math.sqrt(x) for x in n.values())
    want = Counter({i: draw(i, math.sqrt(n[s]) / total * len(rows) / n[s]) for i, s in rows})
    got = mixture(docs).collect()
    assert Counter(r["doc_id"] for r in got) == +want
    keys = [r["shuffle_key"] for r in got]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_weights_hold_on_average(spark):
    rows = [(i, "t", "hot" if i % 3 else f"s{i % 7}") for i in range(30_000)] + [(None, None, None)] * 3
    weights = spark.createDataFrame([("hot", 1.0), ("s0", 1.0), ("s3", 2.0), ("none", 5.0)], "source string, weight double")
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (50_000, 0):  # broadcast and shuffle join
        got = Counter(r["mix_source"] for r in mix_sources(df, weights, total=9000, broadcast_rows=limit).select("mix_source").collect())
        whole = 4.0  # a weight without rows does not count
        for s, w in (("hot", 1), ("s0", 1), ("s3", 2)):
            assert abs(got[s] - 9000 * w / whole) < 150
        assert set(got) == {"hot", "s0", "s3"}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "", "a"), (2, "x " * 100_000, "a")], SCHEMA).selectExpr("*", "1 as rate", "'z' as mix_source")
    out = mix_sources(df.drop("mix_source"), total=400).collect()
    assert abs(len(out) - 400) < 80 and {r["rate"] for r in out} == {1}
    assert mixture(df.limit(0)).collect() == []


def test_high_rates_are_poisson(spark):
    rows = [(i, None, "rare" if i < 1500 else "rest") for i in range(3000)]
    weights = spark.createDataFrame([("rare", 268.0), ("rest", 0.0)], "source string, weight double")
    out = mix_sources(spark.createDataFrame(rows, SCHEMA), weights, total=1500 * 268)
    n = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert n == Counter({i: draw(i, 268.0) for i in range(1500)})
    mean = sum(n.values()) / 1500
    var = sum((n[i] - mean) ** 2 for i in range(1500)) / 1499
    assert abs(mean - 268) < 2 and 0.85 < var / 268 < 1.15  # the variance of a Poisson count is its mean


def test_sql_with_high_rates(spark):
    """The query's SQL on a table where rare sources have rates far above one draw."""
    rows = [(i, None, f"s{i}" if i < 3 else "big") for i in range(20_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    db = duckdb.connect()
    db.register("documents", pd.DataFrame({"doc_id": [r[0] for r in rows], "source": [r[2] for r in rows]}))
    want = db.execute(ORACLE_SQL).fetchall()
    got = mixture(docs).select("doc_id", "source", "copy", "shuffle_key").collect()
    assert sorted(want) == sorted(tuple(r) for r in got)
    assert sum(r["source"] == "s0" for r in got) > 60  # a rate of about 130


def test_columns_with_the_names_of_results(spark):
    df = spark.createDataFrame([(i, "t", "a", i, "n", 7) for i in range(50)], SCHEMA + ", mix_count long, mix_note string, mix_order int")
    out = mix_sources(df, total=200)
    assert out.columns == [*df.columns, "mix_source", "mix_copy", "mix_order_"]
    rows = shuffled(out, "mix_order_").collect()
    assert rows and all(r["mix_count"] == r["doc_id"] and r["mix_note"] == "n" and r["mix_order"] == 7 for r in rows)
    assert [r["mix_order_"] for r in rows] == sorted(r["mix_order_"] for r in rows)
