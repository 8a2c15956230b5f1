import math
import zlib

import numpy as np

from terracell.llm.common import table
from terracell.llm.quality import SLOTS, held_out, quality_scores, score, score_text, share, slots, train, train_shard

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_score_is_the_dot_product_of_shares(spark):
    w = np.random.default_rng(1).normal(size=SLOTS + 1).astype(np.float32)
    text = "The the cat SAT!! on it, it *** 42".encode() * 3
    at, x = share(text)
    assert np.isclose(score_text(text, w), 1 / (1 + np.exp(-(w[at].astype(float) @ x + w[SLOTS]))), atol=1e-6)
    assert all(len(s) == 0 for s in slots(b""))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "k"), (None, "a b", "k"), (2, "", "k"), (2, "", "k"), (3, "x" * 200_000 + " y" * 50_000, "k")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in score(docs, train(docs, none)).collect()] == [1.0] * 5
    some = spark.createDataFrame([(2, 1), (3, 0), (None, 1), (9, 0), (1, None)], "doc_id long, quality int")
    out = quality_scores(docs, some).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert quality_scores(docs.limit(0), some).collect() == []
    assert docs.select(held_out(docs.doc_id)).first()[0] is False


def test_training_against_a_plain_ftrl(spark):
    """One coordinate at a time, straight from the update rule, on a small fixture."""
    rows = sorted((r["text"] or "", r["quality"]) for r in table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id").filter("length(text) < 400").limit(40).collect())
    rows = [(t.encode(), y) for t, y in rows] + [(b"", 1)]
    alpha, beta, l1, l2 = 2.0, 1.0, 1e-4, 1e-4
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(3):
        for text, y in rows:
            at, x = share(text)
            vector = {**dict(zip(at.tolist(), x.tolist())), SLOTS: 1.0}
            w = {k: weight(k) for k in vector}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in vector.items())))
            for k, v in vector.items():
                g = (p - y) * v
                before = n.get(k, 0.0)
                sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = before + g * g
    got = train_shard([(share(t), y) for t, y in rows], 3)
    want = np.zeros(SLOTS + 1)
    for k in z:
        want[k] = weight(k)
    assert len(rows) > 20 and np.abs(want).max() > 0.1 and np.allclose(got, want, atol=1e-9)


def test_a_score_at_the_threshold_is_good(spark):
    docs, labels = table(spark, SF, "documents").limit(50), table(spark, SF, "labels")
    tied = quality_scores(docs, labels).first()["score"]
    rows = quality_scores(docs, labels, threshold=tied).collect()
    assert any(r["score"] == tied for r in rows) and all(r["predicted"] == int(r["score"] >= tied) for r in rows)


def test_memory_belongs_to_one_operator_at_a_time():
    from terracell.llm import toxicity
    from terracell.llm.quality import _words

    before = slots(b"one two three")
    assert len(_words.number) > 0
    toxicity.bag("one two three")
    assert len(_words.number) == 0 and len(toxicity._words) > 3
    after = slots(b"one two three")
    assert all(np.array_equal(a, b) for a, b in zip(before, after)) and len(toxicity._words) == 4  # the marks alone
