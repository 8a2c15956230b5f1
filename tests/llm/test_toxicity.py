import zlib

import numpy as np

from terracell.llm import toxicity
from terracell.llm.common import table
from terracell.llm.toxicity import SLOTS, bag, gradient, judge, noisy_or, toxic_sentences, toxicity_digests, train

SF = "/root/testdata/sf0.01"


def test_held_out_documents_and_named_sentences(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxic_sentences(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.93
    assert np.mean([r["predicted"] for r in held if r["toxic"]]) > 0.7 and np.mean([r["predicted"] for r in held if not r["toxic"]]) < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and bool(r["offending"]) == bool(r["predicted"]) for r in rows)
    for r in rows:
        for s in r["offending"]:
            assert not set(r["text"][s["start"] : s["end"]]) & set(".!?\n")


def test_sentences_are_found_in_unseen_documents(spark):
    """Labels say only which document is toxic; one of its many sentences has the word."""
    rng = np.random.default_rng(5)
    plain = [f"w{k}" for k in range(60)]
    sentence = lambda extra=(): " ".join([*rng.choice(plain, 8), *extra])
    rows, labels, where = [], [], {}
    for i in range(600):
        parts = [sentence() for _ in range(12)]
        if i % 5 == 0:
            where[i] = int(rng.integers(12))
            parts[where[i]] = sentence([["vile", "nastiness", "nastily"][i % 3]])
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, int(i % 5 == 0)))
    out = toxic_sentences(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 100 and all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    for r in held:
        if r["predicted"]:
            spans = [rows[r["doc_id"]][1][s["start"] : s["end"]] for s in r["offending"]]
            assert spans == [rows[r["doc_id"]][1].rstrip(".").split(". ")[where[r["doc_id"]]]]


def test_noisy_or_and_its_gradient():
    rng = np.random.default_rng(2)
    z = rng.normal(size=7)
    assert np.isclose(noisy_or(z), 1 - np.prod(1 - 1 / (1 + np.exp(-z))))
    rows = [(int(y), 4, rng.integers(0, 4, 9), rng.integers(0, 5, 9)) for y in (0, 1, 1, 0)]

    def loss(w):
        total = 0.0
        for y, n, s, at in rows:
            p = 1 - np.prod(1 - 1 / (1 + np.exp(-(w[-1] + np.bincount(s, w[:-1][at], minlength=n)))))
            total -= np.log(p if y else 1 - p)
        return total

    w = rng.normal(size=6)
    numeric = [(loss(w + 1e-6 * e) - loss(w - 1e-6 * e)) / 2e-6 for e in np.eye(6)]
    assert np.allclose(gradient(rows, w[:-1], w[-1]), numeric, atol=1e-5)


def test_bags():
    sentence, slots = bag("One two two. THREE!? Four\nfive")
    assert sentence.tolist() == [0, 0, 1, 2, 3] and slots.shape == (5, 3)
    assert (slots[0] == slots[0, 0]).sum() == 1 and slots[0, 1] == SLOTS  # a word of three letters has no prefixes
    assert bag("three")[1].tolist() == slots[2:3].tolist()
    for empty in ("", " ", "...", "\n\n!"):
        assert len(bag(empty)[0]) == 0


def test_words_that_are_forgotten_come_back_the_same(monkeypatch):
    text = " ".join(f"word{k}x" for k in range(50)) + ". the end"
    want = bag(text)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 10)
    for _ in range(3):
        got = bag(text)
        assert sorted(map(tuple, got[1].tolist())) == sorted(map(tuple, want[1].tolist())) and np.bincount(got[0]).tolist() == np.bincount(want[0]).tolist()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "k"), (None, "a b", "k"), (2, "", "k"), (2, "", "k"), (3, "x" * 200_000 + " y." * 50_000, "k")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert train(docs, none) is None
    assert [(r["score"], r["predicted"], r["offending"]) for r in toxicity_digests(docs, none).collect()] == [(0.0, 0, "")] * 5
    some = spark.createDataFrame([(2, 1), (3, 0), (None, 1), (9, 0), (1, None)], "doc_id long, toxic int")
    out = toxicity_digests(docs, some).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity_digests(docs.limit(0), some).collect() == []
    weights = np.zeros(SLOTS + 2, np.float32)
    assert judge("", weights) == (0.0, []) and judge("a", weights, 0.5)[1] == [(0, 1, 0.5)]
