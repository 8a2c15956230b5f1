import hashlib
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from terracell.llm.common import table
from terracell.llm.exact_dedup import BROADCAST, bucket_at, build_index, directory, exact_dedup, probe, without_copies
from terracell.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [(k, f"text {k % 37}") for k in range(300)] + [(k, "hot") for k in range(300, 500)]
    rows += [(500, None), (501, ""), (None, "text 1"), (None, "only"), (502, " hot"), (503, "hot "), (504, "é"), (505, "é"), (7, "text 7"), (506, "x" * 300_000), (507, "x" * 300_000), (508, "x" * 300_000 + "y")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, key int, bucket string").repartition(5)
    for bucket_rows in (4096, 3):
        got = sorted((tuple(r) for r in exact_dedup(df, bucket_rows).collect()), key=str)
        assert got == brute(rows)
    kept = Counter(r["text"] for r in without_copies(df.filter("doc_id IS NOT NULL AND doc_id <> 7")).collect())
    assert all(n == 1 or t is None for t, n in kept.items()) and len(kept) == len({t or "" for i, t in rows if i not in (None, 7)})


def test_buckets_split_until_they_fit(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    buckets, depths = directory(keys, 100)
    ways = keys.select("key", F.explode(F.array(*[F.struct(bucket_at(F.col("key"), d).alias("bucket"), F.lit(d).alias("local_depth")) for d in depths])).alias("w"))
    held = ways.select("key", "w.*").join(buckets, ["bucket", "local_depth"])
    sizes = held.groupBy("bucket", "local_depth").count().collect()
    assert sum(r["count"] for r in sizes) == 20_000  # each key has one bucket
    assert all(r["count"] <= 100 for r in sizes)
    assert len({r["local_depth"] for r in sizes}) > 1  # buckets differ in depth
    # a bucket is as shallow as possible: with its sibling it would not fit
    every = [r["key"] % 2**64 for r in keys.collect()]
    whole = {d: Counter(k >> (65 - d) for k in every) for d in depths}
    assert all(whole[r["local_depth"]][(r["bucket"] % 2**64) >> (65 - r["local_depth"])] > 100 for r in sizes)


def test_keys_that_share_most_bits_split_to_the_end(spark):
    """The directory doubles until a bucket fits, however deep that is; a single key always fits."""
    keys = spark.range(7).select(F.shiftleft("id", 56).alias("key"))
    buckets, depths = directory(keys, 2)
    assert max(depths) == 7 and sorted((r["bucket"] >> 56, r["local_depth"]) for r in buckets.collect()) == [(0, 7), (2, 7), (4, 7), (6, 7)]


def test_index_owns_ranges_of_keys(spark):
    index = build_index(table(spark, "/root/testdata/sf0.01", "documents"), 50).entries
    spans = index.groupBy("bucket").agg(F.expr("min(shiftrightunsigned(key, 1))").alias("lo"), F.expr("max(shiftrightunsigned(key, 1))").alias("hi")).orderBy("lo").collect()
    assert len(spans) > 10 and all(a["hi"] <= b["lo"] for a, b in zip(spans, spans[1:]))
    assert index.agg(F.max("chain")).first()[0] == 1  # no two texts share a key here


def colliding(text):
    """Five keys for all texts."""
    return F.xxhash64(F.length(text) % 5)


def test_chains_of_colliding_keys(spark):
    rows = [(k, f"text {k % 41}") for k in range(200)] + [(k, "hot") for k in range(200, 400)] + [(400, None), (401, ""), (None, "text 1"), (402, "text 40"), (402, "text 40"), (3, "xet 1x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    index = build_index(df, 2, colliding)
    by_key = Counter(r["key"] for r in index.entries.collect())
    assert max(by_key.values()) > 10 and sum(by_key.values()) == len({t or "" for _, t in rows})
    assert sorted((tuple(r) for r in exact_dedup(df, 2, colliding).collect()), key=str) == brute(rows)
    assert Counter(r["text"] or "" for r in without_copies(df, 2, colliding).collect()) == Counter({t or "" for _, t in rows})


def test_decisions_come_from_the_index(spark):
    """What the directory or a chain says is what a row gets; nothing else decides."""
    rows = [(k, f"text {k % 60}") for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = build_index(df, 5)
    lost = index.buckets.orderBy("bucket").first()
    whole, index.buckets = index.buckets, index.buckets.filter(F.col("bucket") != lost["bucket"])
    inside = {r["key"] for r in index.entries.filter(F.col("bucket") == lost["bucket"]).collect()}
    key = {r["text"]: r["key"] for r in df.select("text", F.xxhash64("text").alias("key")).collect()}
    assert inside
    assert {r["doc_id"] for r in probe(df, index).collect()} == {i for i, t in rows if key[t] not in inside}
    index.buckets = whole
    index.entries = index.entries.withColumn("keep_id", -F.col("keep_id"))
    assert all(r["keep_id"] <= 0 for r in probe(df, index).collect())
    index.entries = index.entries.withColumn("bucket", F.col("bucket") + 1)
    assert probe(df, index).collect() == []


def test_more_copied_keys_than_a_broadcast_holds(spark, monkeypatch):
    import terracell.llm.exact_dedup as module

    rows = [(k, f"text {k % 53}") for k in range(300)] + [(k, "hot") for k in range(300, 500)] + [(5, "text 5")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(module, "BROADCAST", 20)
    assert BROADCAST > 20
    for key in (F.xxhash64, colliding):
        assert sorted((tuple(r) for r in exact_dedup(df, 4, key).collect()), key=str) == brute(rows)
        assert Counter(r["text"] for r in without_copies(df, 4, key).collect()) == Counter({t for _, t in rows})


def test_repeated_rows_and_ids_leave_one_row_a_text(spark):
    rows = [(1, "T", 1), (1, "T", 1), (2, "x", 1), (2, "T", 2), (2, "T", 3), (1, "A", 0), (1, "B", 0), (2, "A", 0), (None, "N", 0), (None, "N", 0)]
    df = spark.createDataFrame(rows, SCHEMA + ", dedup_key int")
    kept = without_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["text"], r["doc_id"] or 0) for r in kept.collect()) == [("A", 2), ("B", 1), ("N", 0), ("T", 2), ("x", 2)]


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_queries_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, sf)
        found = db.execute(sql)
        order = [[x[0] for x in found.description].index(c) for c in df.columns]
        assert sorted(tuple(r[k] for k in order) for r in found.fetchall()) == sorted(tuple(r) for r in df.collect())
