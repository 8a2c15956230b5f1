import random
import zlib
from collections import Counter

import numpy as np

from terracell.llm import spelling
from terracell.llm.common import table
from terracell.llm.spelling import WaveletTree, candidate_groups, near_counts, near_words, spelling_variants, word_counts

SCHEMA = "doc_id long, text string"


def plain_words(rows):
    total = Counter()
    for i, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
                run = ""
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b if words[b] >= 5 * words[w] else None for w, b in best.items()}
    out = {}
    for w in words:
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out[w] = (f, root, words[w], len(near[w]), words[f] if f else None)
    return out


def random_vocabulary(seed, n, letters="abé", most=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(6, most))): rng.choice([5, 6, 7, 40, 300, 2000]) for _ in range(n)}


def frame(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n long")


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.permutation(n)
        tree = WaveletTree(values)
        a, b, c, d = (rng.integers(0, n + 1, 200) for _ in range(4))
        q, v = tree.report(a, b, c, d)
        want = sorted((k, x) for k in range(200) for x in values[a[k] : b[k]] if c[k] <= x < d[k])
        assert sorted(zip(q.tolist(), v.tolist())) == want


def test_near_words_of_a_group():
    words = sorted(w for w in random_vocabulary(2, 300, "ab", 8) if len(w) in (6, 7))
    n = np.arange(len(words)) % 7
    count, best = near_words(7, 0, 7, np.zeros(len(words)), [w.encode() for w in words], n)
    for k, w in enumerate(words):
        near = [j for j, v in enumerate(words) if one_edit(w, v) and not len(w) == len(v) == 6]
        assert count[k] == len(near) and best[k] == min(near, key=lambda j: (-n[j], words[j]), default=-1)


def test_vocabulary_against_all_pairs(spark):
    words = random_vocabulary(7, 900)
    want = {w: x for w, x in plain_variants(words).items() if x[3]}
    for group_bytes in (spelling.GROUP_BYTES, 300):  # the second splits most groups
        got = {r["word"]: (r["n_near"], r["best_n"]) for r in near_counts(frame(spark, words), group_bytes).collect()}
        assert got == {w: (x[3], max(words[v] for v in words if one_edit(w, v))) for w, x in want.items()}


def test_groups_that_are_too_large_are_split(spark):
    """A third of all words share their first half, and another third their last."""
    rng = random.Random(9)
    words = {"lettersx" + "".join(rng.choice("abcdefgh") for _ in range(8)): 5 for _ in range(300)} | {"".join(rng.choice("abcdefgh") for _ in range(8)) + "lettersx": 5 for _ in range(300)}
    words |= {w[:9] + "z" + w[10:]: 50 for w in list(words)[:40]}
    groups = candidate_groups(frame(spark, words), 1600)
    sizes = groups.groupBy("m", "lo", "hi", "key").count().collect()
    assert max(r["count"] for r in sizes if r["hi"] - r["lo"] > 1) * 16 <= 1600
    want = {w: x[3] for w, x in plain_variants(words).items() if x[3]}
    assert {r["word"]: r["n_near"] for r in near_counts(frame(spark, words), 1600).collect()} == want


def test_texts_against_all_pairs(spark):
    rng = random.Random(11)
    base = ["window", "wíndow", "windows", "widow", "Straße", "strasse", "straßen", "lettering", "lettring", "×÷×÷×÷", "ABCDEF", "abcdeff"]
    rows = [(i, " ".join(rng.choices(base, range(len(base), 0, -1), k=rng.randrange(0, 80))) + rng.choice(["", "Ā", "\U0001f600 end", "\n"])) for i in range(120)]
    rows += [(None, "window window"), (7, None), (7, ""), (3, "window " * 3000), (8, "q" * 100_000), (8, rows[8][1]), (8, rows[8][1])]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    words = plain_words(rows)
    assert got == plain_variants(words) and any(x[0] for x in got.values())


def test_chains_end_at_their_roots(spark):
    chain = {"aaaaaa": 5, "aaaaab": 30, "aaaabb": 200, "aaabbb": 1100, "aabbbb": 6000, "abbbbb": 31000}
    links = spark.createDataFrame(list(zip(chain, list(chain)[1:])), "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(links).df.collect()} == {w: "abbbbb" for w in list(chain)[:-1]}


def test_damage_and_small_tables(spark):
    assert word_counts(spark.createDataFrame([], SCHEMA)).collect() == [] and spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, None), (2, "")], SCHEMA + "")).collect() == []
    hit = next(i for i in range(5000) if zlib.crc32(f"{i}:windows".encode()) % 199 == 0)
    rows = [(hit, "windows " * 5, 1)]
    h = zlib.crc32(f"{hit}:windows".encode())
    assert [(r["word"], r["n"]) for r in spelling_variants(spark.createDataFrame(rows, SCHEMA + ", form int")).collect()] == [("windows"[: h % 7] + "windows"[h % 7 + 1 :], 5)]
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert {r["word"]: r["n"] for r in word_counts(docs).collect()} == plain_words([(r["doc_id"], r["text"]) for r in docs.collect()])
