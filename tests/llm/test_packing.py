import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from terracell.llm.common import table
from terracell.llm.packing import crossover, evolve, lower_bound, pack, pack_documents, packed_by_best_fit, pieces_of, replace
from terracell.llm.tokens import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def check(rows, size):
    """No overlap, no gap, nothing too long; the number of sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return len(by)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = pack_documents(docs, PATH, 0).collect()
    tok, want = Tokenizer.from_file(PATH), set()
    for d in docs.collect():
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for k, (s, n) in enumerate(pieces_of(len(ids), 2048)):
            want.add((d["doc_id"], k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    assert check(rows, 2048) <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_many_demes_stay_near_the_bound(spark):
    rng = np.random.default_rng(4)
    length = np.clip(rng.lognormal(5, 1, 6000).astype(int), 1, 2048)
    df = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(length)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = pack(df, deme=1000).collect()
    assert len(rows) == 6000 and check(rows, 2048) <= length.sum() / 2048 * 1.005 + 1
    big = df.withColumn("length", df.length * 0 + 1100)  # no two fit together
    assert check(pack(big, deme=1000).collect(), 2048) == 6000


def test_children_hold_each_piece_once():
    rng = np.random.default_rng(5)
    length = rng.integers(1, 1500, 400)
    a, b = (evolve(length, [], 2048, np.random.default_rng(s), turns=0, population=3) for s in (1, 2))
    for _ in range(20):
        a = crossover(a, b, length, 2048, rng)
        assert len(a) == 400 and np.bincount(a, length).max() <= 2048


def triplets(rng, n, size):
    """Lengths that fill n sequences with three pieces each, and no other number of pieces."""
    out = []
    for _ in range(n):
        x = rng.integers(size * 19 // 50, size * 49 // 100)
        y = rng.integers(size // 4 + 1, (size - x) // 2 + 1)
        out += [x, y, size - x - y]
    return rng.permutation(np.array(out))


def test_search_beats_best_fit():
    rng, won, counts = np.random.default_rng(8), 0, []
    for k in range(6):
        length = triplets(rng, 20, 2048)
        plain = packed_by_best_fit(length, 2048).max() + 1
        found = evolve(length, [], 2048, np.random.default_rng(k))
        assert np.bincount(found, length).max() <= 2048
        used = len(np.unique(found))
        assert lower_bound(length, 2048) == 20 <= used <= plain
        counts.append((used, plain))
        won += used < plain
    assert won == 6, counts


def test_islands_beat_best_fit_on_a_table(spark):
    length = triplets(np.random.default_rng(9), 200, 2048)
    df = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(length)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    plain = packed_by_best_fit(length, 2048).max() + 1
    used = check(pack(df).collect(), 2048)
    assert 200 <= used < plain, (used, plain)


def test_replacement_fills_a_sequence():
    length = np.array([900, 700, 1000, 448, 300, 1148])
    members, spare = replace([0, 1], np.array([4, 3, 2, 5]), length, 2048)
    assert length[members].sum() == 2048 and sorted([*members, *spare]) == list(range(6)) and list(length[spare]) == sorted(length[spare])
    assert replace([0], np.array([], np.int64), length, 2048)[0] == [0]


def test_odd_rows(spark):
    rows = [(5, None), (5, None), (None, "a b"), (-3, "word " * 9000), (9, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece int")
    out = pack_documents(df, PATH, 0).collect()
    check(out, 2048)
    assert sorted((r["doc_id"], r["length"]) for r in out if r["doc_id"] is not None and r["doc_id"] > 0) == [(5, 1), (5, 1), (9, 1)]
    assert pack_documents(df.limit(0), PATH, 0).collect() == []
    assert pieces_of(4096, 2048) == [(0, 2048), (2048, 2048)] and pieces_of(4097, 2048)[0] == (0, 1) and pieces_of(2048, 2048) == [(0, 2048)]


def test_islands_decide_for_demes_beside_others(spark):
    """Several demes of triplets: best fit in each needs more than its bound, whatever else is packed beside it, and the
    islands win strictly against best fit of each deme and of all pieces."""
    length = np.concatenate([triplets(np.random.default_rng(20 + k), 100, 2048) for k in range(4)])
    df = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(length)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    used = check(pack(df, deme=300).collect(), 2048)
    plain = packed_by_best_fit(length, 2048).max() + 1
    assert lower_bound(length, 2048) == 400 <= used < plain, (used, plain)


def test_a_deme_one_above_its_bound_is_searched_beside_others(spark, monkeypatch):
    """What counts as done is the bound itself, for one deme and for many."""
    from terracell.llm import packing

    done = []
    plain = packing.lower_bound
    monkeypatch.setattr(packing, "lower_bound", lambda length, size: done.append(len(length)) or plain(length, size))
    length = np.array([1500] * 3 + [600] * 3 + [500, 548, 500, 548] * 2)
    out = packing._pack_once(spark.createDataFrame([(i, 0, 0, int(n), 0, 1) for i, n in enumerate(length)], packing._ITEM), 2, 2048, 0)
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"] >> 24, []).append(r)
    for rows_of in by.values():
        own = np.array([r["length"] for r in rows_of])
        assert len({r["sequence_id"] for r in rows_of}) >= plain(own, 2048)
    assert len(rows) == len(length)
