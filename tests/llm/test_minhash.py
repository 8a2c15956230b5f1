import itertools
import random

import numpy as np

from terracell.llm.common import table
from terracell.llm.minhash import document_frequencies, idf_table, near_duplicates, one_of_each_class, sampler, shingles, similarity, weigh


def brute(rows, threshold=0.8):
    """Classes over all pairs, with exact document frequencies."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    df: dict = {}
    for _, t in rows:
        for f in shingles(t)[0].tolist():
            df[f] = df.get(f, 0) + 1
    n, vec = len(rows), {}
    for i, t in rows:
        f, tf = shingles(t)
        vec[i] = f, (1 + np.log(tf)) * np.log1p(n / (n + np.array([df[x] for x in f.tolist()], float)))
    root = {i: i for i in vec}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    text = dict(rows)
    for a in vec:
        for b in vec:
            if a < b and (text[a] == text[b] or similarity(vec[a], vec[b]) >= threshold):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in vec}


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    common = [word() for _ in range(40)]
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(30, 200))] + common
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    hub = [word() for _ in range(150)]
    for _ in range(60):
        w = list(hub)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [None, "", "a b", "a b", "a b c d e", "x " * 5000, "x " * 5001, rows[0], rows[0]]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(df).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_unlike_documents_that_share_a_long_passage(spark):
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage, rows = words(404), []
    for k in range(240):
        tail = words(35)
        rows.append(" ".join(passage + tail))
        if k % 3 == 0:
            rows.append(" ".join(passage + tail[:10] + words(25)))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute(rows)
    assert len(set(want.values())) == 240
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()} == want


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    hits = []
    for s in range(40):
        g = f + np.uint64(s)
        w1, w2 = rng.uniform(0.2, 3, 300), None
        w2 = w1 * rng.uniform(0.6, 1.5, 300)
        hits.append((np.mean(sampler().sample(g, w1) == sampler().sample(g, w2)), np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()))
    got, want = np.mean(hits, axis=0)
    assert abs(got - want) < 0.03


def test_frequencies_and_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e"), (3, "")], "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) text")
    held, n = document_frequencies(rows)
    assert n == 3 and held.sum() == 2 * 3
    f, w = weigh(b"a b c d e", idf_table(held, n))
    assert np.isclose(w[0], np.log1p(3 / 5))
    odd = spark.createDataFrame([(None, "p q", 1), (4, "p q", 1), (4, "p q", 1)], "doc_id long, text string, label int")
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in near_duplicates(odd).collect()) == [(0, 0, True), (4, 4, True), (4, 4, True)]
    assert near_duplicates(odd.limit(0)).collect() == []


def test_repeated_rows_and_ids(spark):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, "T t t t t t"), (1, "T t t t t t"), (2, "x"), (2, "T t t t t t"), (3, long), (3, long + " more"), (4, "y"), (4, "z"), (4, "z"), (None, "x"), (None, "x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, near_id int").repartition(3)
    got = sorted((r["doc_id"], r["class_id"]) for r in near_duplicates(df).collect() if r["doc_id"] is not None)
    assert got == [(1, 1), (1, 1), (2, 1), (2, 2), (3, 3), (3, 3), (4, 4), (4, 4), (4, 4)]
    out = one_of_each_class(df)
    assert out.columns == df.columns
    kept = sorted((r["doc_id"] or 0, r["text"][:9]) for r in out.collect())
    assert kept == [(0, "x"), (0, "x"), (1, "T t t t t"), (2, "x"), (3, long[:9]), (4, "y"), (4, "z")]


def test_recall_over_the_whole_table(spark):
    """Rows whose id is divisible by 20 against all rows, and all against all: pairs of similarity 0.8 share a class."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())
    made, df = {i: shingles(t) for i, t in rows}, {}
    for f, _ in made.values():
        for x in f.tolist():
            df[x] = df.get(x, 0) + 1
    n = len(rows)
    vec = {i: (f, (1 + np.log(tf)) * np.log1p(n / (n + np.array([df[x] for x in f.tolist()], float)))) for i, (f, tf) in made.items()}
    total = {i: w.sum() for i, (_, w) in vec.items()}
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    near = []
    for a, b in itertools.combinations(vec, 2):
        if min(total[a], total[b]) >= 0.8 * max(total[a], total[b]) > 0 and similarity(vec[a], vec[b]) >= 0.8:
            near.append((a, b))
    queried = [p for p in near if p[0] % 20 == 0 or p[1] % 20 == 0]
    for pairs, least in ((queried, 5), (near, 80)):
        hits = sum(found[a] == found[b] for a, b in pairs)
        assert len(pairs) >= least and hits >= 0.9 * len(pairs), (hits, len(pairs))
