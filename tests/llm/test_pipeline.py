from collections import Counter

import corpus_pipeline
from terracell.llm.common import documents, table
from terracell.llm.mixing import mixture
from terracell.llm.packing import pieces_of
from terracell.llm.quality import quality_scores
from terracell.llm.tokens import encoder, vocabulary

from .test_minhash import brute as classes
from .test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = documents(spark, SF)
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in ("quality", "exact", "near", "mix"):
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    text = {r["doc_id"]: r["text"] for r in documents(spark, SF).collect()}
    good = [r["doc_id"] for r in quality_scores(documents(spark, SF), table(spark, SF, "labels")).collect() if r["predicted"] == 1]
    assert sorted(i for i, *_ in kept["quality"]) == sorted(good) and len(good) < len(text)
    last = {}
    for i in sorted(good):
        last[text[i]] = i
    assert sorted(i for i, *_ in kept["exact"]) == sorted(last.values())
    near = classes([(i, t) for i, t, _ in kept["exact"]])
    assert sorted(i for i, *_ in kept["near"]) == sorted(set(near.values()))
    near_docs = spark.read.parquet(f"file://{tmp_path}/near")
    assert Counter(i for i, *_ in kept["mix"]) == Counter(r["doc_id"] for r in mixture(near_docs).collect())
    packed = stages["pack"](spark, docs, SF).collect()
    check(packed, 2048)
    enc, want = encoder(vocabulary("byte_bpe_50k.json"), True), Counter()
    for i, t, _ in kept["mix"]:
        want.update((i, k, s, n) for k, (s, n) in enumerate(pieces_of(len(enc.encode(t)) + 1, 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in packed) == want


def test_run_and_empty_documents(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_odd_documents_in_one_run(spark, tmp_path):
    """Null and repeated ids and texts, rows repeated in full, very long texts, and columns named like the stages' own."""
    own = documents(spark, SF).limit(40).selectExpr("doc_id", "text", "lang", "source")
    long = " ".join(f"word{k % 700}" for k in range(30_000))
    rows = [(None, None, None, None), (None, "a b c", "en", "s"), (7, "Same text here.", "en", None), (7, "Same text here.", "en", None), (8, "Same text here.", None, "s"), (9, "", "en", "s"), (10, long, "en", "s"), (11, long + " end", "en", "s"), (7, "Another text of this id.", "en", "s")]
    odd = own.union(spark.createDataFrame(rows, own.schema)).selectExpr("*", "1 AS score", "'k' AS keep_id", "2 AS shard", "3 AS copies", "'x' AS label")
    docs, before = odd, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == odd.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs, before = spark.read.parquet(f"file://{tmp_path}/{name}"), docs
    check(docs.collect(), 2048)
    exact = spark.read.parquet(f"file://{tmp_path}/exact")
    assert exact.selectExpr("coalesce(text, '') AS t").groupBy("t").count().filter("count > 1").collect() == [] and exact.count() > 10
    assert before.count() > 0
