import hashlib
import random

from terracell.llm.substring_dedup import COVER, PERIOD, cover_positions, repeated_spans, substring_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, window=50):
    """Straight from the definition: every window of every document against the smaller documents."""
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone.update(range(p, p + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in substring_dedup(df).collect()), key=str)


def test_cover_meets_every_shift():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    assert list(cover_positions(30)) == sorted(COVER)


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(150):
        parts = [[word() for _ in range(rng.randint(0, 60))], rng.choice(passages), [word() for _ in range(rng.randint(0, 60))], rng.choice(passages)[rng.randint(0, 30) :]]
        rows.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w for p in parts for w in p)))
    rows += [(150, None), (151, ""), (None, rows[0][1]), (152, rows[3][1]), (152, rows[3][1]), (153, "x " * 3000), (154, "x " * 70), (155, "a b " * 60), (156, "a b " * 60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert run(df) == brute(rows)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a " * 60, 7, "z"), (2, "a " * 60, 8, "y")], "doc_id long, text string, pos int, k string")
    assert [r[2] for r in sorted(substring_dedup(df).collect())] == [0, 60]
    spans = repeated_spans(df).collect()
    assert [r["doc_id"] for r in spans] == [2] and {x for s in spans[0]["spans"] for x in range(s["lo"], s["hi"])} == set(range(60))
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_id_with_several_texts(spark):
    """Each text is judged for itself: against smaller ids, never against the others of its id."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    passage, other = [[word() for _ in range(70)] for _ in range(2)]
    text = lambda *parts: " ".join(w for p in parts for w in p)
    filler = [word() for _ in range(300)]
    rows = [(1, text(passage)), (5, text(filler, passage)), (5, text([word() for _ in range(60)]))]
    assert run(spark.createDataFrame(rows, SCHEMA).coalesce(1)) == brute(rows)
    for seed in range(3):
        rng.seed(seed)
        parts = [passage, other, filler[:55], filler[100:180]]
        rows = [(rng.randrange(6), text(*[rng.choice(parts)[rng.randint(0, 9) :] if rng.random() < 0.7 else [word() for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(0, 4))])) for _ in range(60)]
        rows += [rows[3], rows[4], (None, rows[5][1]), (2, None), (2, "")]
        for pieces in (1, 4):
            assert run(spark.createDataFrame(rows, SCHEMA).repartition(pieces)) == brute(rows)
