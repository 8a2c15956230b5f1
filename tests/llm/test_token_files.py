import zlib

import numpy as np
from tokenizers import Tokenizer

from terracell.llm.common import scratch_path, table
from terracell.llm.huffman import Decoder, code_lengths, codes, encode
from terracell.llm.token_files import read_token_files, token_file_digests, write_token_files
from terracell.llm.tokens import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def test_code_is_prefix_free_limited_and_optimal():
    rng = np.random.default_rng(2)
    for n, limit in ((1, 16), (2, 16), (7, 3), (300, 9), (5000, 16)):
        counts = np.floor(rng.pareto(0.3, n) * 3).astype(np.int64) + 1
        lengths = code_lengths(counts, limit)
        assert lengths.max() <= limit and (n == 1 or np.isclose((2.0 ** -lengths.astype(float)).sum(), 1))
        text = [format(int(c), f"0{k}b") for c, k in zip(codes(lengths), lengths)]
        assert len(set(text)) == n and not any(a != b and b.startswith(a) for a in text[:200] for b in text[:200])
    # without a binding limit the cost is that of plain Huffman coding
    import heapq

    counts = rng.integers(1, 1000, 200)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert int((counts * code_lengths(counts, 16)).sum()) == cost


def test_round_trip_of_ids():
    rng = np.random.default_rng(3)
    for n in (1, 127, 128, 129, 5000):
        ids = np.minimum(rng.geometric(0.02, n), 900)
        lengths = code_lengths(np.bincount(ids, minlength=1000))
        bits, at = encode(ids, lengths, codes(lengths), 128)
        assert (Decoder(lengths).decode(bits, at, n, 128) == ids).all()


def want(rows):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digests(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in token_file_digests(docs.repartition(7), PATH, 2).collect()) == want(rows)


def test_odd_rows(spark):
    rows = [(5, None), (5, None), (None, "a b"), (-3, "word " * 30_000), (9, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    assert sorted((tuple(r) for r in token_file_digests(df, PATH, 2).collect()), key=lambda r: r[1]) == want(rows)
    assert token_file_digests(df.limit(0), PATH, 2).collect() == []
    back = read_token_files(spark, write_token_files(df, scratch_path(spark, "t"), PATH, 2)).filter("doc_id = 9").collect()
    assert back[0]["ids"] == [2]
