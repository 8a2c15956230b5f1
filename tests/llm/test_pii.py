import hashlib
import random
import re
import time

from pyspark.sql import functions as F
from terracell.llm.common import table
from terracell.llm.pii import _meets, label_model, pii_spans, span_classifier, span_digests


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    """Base spans straight from the contract's patterns."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    for kind, (pattern, good) in tests.items():
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if good(m[0])]
    return out


ODD = [
    None, "", "a@b", "a@b.c@d.e", "x.y%+z@q-r.s.t, é@é.é", "日本 a@b.co 語 1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 1.1.1.0001",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111-2 1 2", "+1 (437) 555-0689 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 +++1234567-8", "😀 +4915112345678 😀a@b.de",
    "a@b" + ".c" * 30_000, "1 " * 30_000, "1." * 30_000, "7.7.7.7 " * 3000, "+" * 1000 + "a.b" * 9000,
]


def test_base_spans(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()] + list(enumerate(ODD, 10_000)) + [(None, "q@w.er")]
    got = {r["doc_id"]: r for r in span_digests(pii_spans(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int"))).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k) for s in want) for k in ("email", "ip", "card", "phone")], i
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want[:5])
        assert set(want) <= set(got[i]["spans"].split(",") if got[i]["spans"] else [])


def test_added_spans(spark):
    docs = [(i, f"Words here and there. Contact {n}@mail{i}.example.com or call +1 (437) 555-{1000 + i} now. Version 3.{i} of it.") for i, n in enumerate(["ann", "bob", "cy"] * 60)]
    docs += [(500, "please mail jo [at] site.com today"), (501, "call (415) 555-2671 or so"), (502, "nothing 12 to 34 see at all (4) 5"), (503, "pay 4111.1111.1111.1112 or 4111.1111.1111.1111")]
    got = {r["doc_id"]: r["spans"] for r in span_digests(pii_spans(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert got[501] == "phone:5:19" and got[502] == "" and "email:12:28" in got[500] and got[503] == "card:27:46"


def test_label_model_separates():
    share = label_model({"111111": 500.0, "1111?1": 20.0, "00???0": 400.0, "00??00": 30.0, "11???1": 200.0})
    assert share["111111"] > 0.95 and share["11???1"] > 0.9 and share["00???0"] < 0.1


def test_empty_table(spark):
    assert span_digests(pii_spans(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_long_runs_and_repeated_ids(spark):
    """A run of characters is read once, and matches that begin inside one are found."""
    texts = [
        "x@y." * 500, "1.2.3." * 500, "a@b.com_foo@c.org.x@d", "a@b.c%d@e.f@g.h", "a@b.cd@e.f", "-@-.-@-.-",
        "1.2.3.4.5.6.7.8.9", "1.2.3.4" + "5" * 3000, "mail jo@k.com " * 3000, "1.2.3.4 [at] " * 2000,
    ]
    digest = lambda t: hashlib.sha256(",".join(brute(t)).encode()).hexdigest()
    rows = [(i % 5, t, digest(t)) for i, t in enumerate(texts)]
    rows += [(7, t, digest("")) for t in ("a" * 200_000 + "@", "a" * 100_000 + "@b", "1" * 200_000 + ".2")]  # no match at all
    start = time.monotonic()
    out = span_digests(pii_spans(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))).collect()
    assert time.monotonic() - start < 60
    assert sorted((r["doc_id"], r["base_sha256"]) for r in out) == sorted((i, d) for i, _, d in rows)


def test_random_texts_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab1.9@-+ (é") for _ in range(rng.randint(0, 60)))) for i in range(4000)]
    got = {r["doc_id"]: r["base_sha256"] for r in span_digests(pii_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        assert got[i] == hashlib.sha256(",".join(brute(t)).encode()).hexdigest(), t


def test_shape_adds_to_the_votes():
    """Two patterns with the same votes get different scores where their shapes differ."""
    counts = {("phone", "111111mhbb"): 500.0, ("phone", "111111mnbb"): 20.0, ("phone", "100?0?mxaa"): 300.0, ("phone", "?1??1?mhbb"): 10.0, ("phone", "?1??1?mxaa"): 10.0}
    votes = {}
    for (_, p), n in counts.items():
        votes[p[:6]] = votes.get(p[:6], 0.0) + n
    share = label_model(votes)
    score = span_classifier(counts, {key: share[key[1][:6]] for key in counts})
    doubt = {p: 1 - score["phone", p] for p in ("?1??1?mhbb", "?1??1?mxaa")}
    assert doubt["?1??1?mxaa"] > 10 * doubt["?1??1?mhbb"]


def test_overlaps_by_halving(spark):
    """Against all pairs, on sorted spans that do not overlap each other."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        at, spans = 0, []
        for _ in range(rng.randint(0, 9)):
            start = at + rng.randint(0, 4)
            at = start + rng.randint(1, 4)
            spans.append((start, at))
        start = rng.randint(0, 40)
        rows.append((i, spans, (start, start + rng.randint(1, 6))))
    df = spark.createDataFrame(rows, "i int, spans array<struct<start: int, end: int>>, s struct<start: int, end: int>")
    got = {r["i"]: r["m"] for r in df.select("i", _meets(F.col("spans"), F.col("s")).alias("m")).collect()}
    for i, spans, (start, end) in rows:
        assert got[i] == any(a < end and start < b for a, b in spans)


def test_very_many_spans_in_one_text(spark):
    """Base and loose spans by the ten thousand: time grows with the text, not with its square."""
    line = lambda i: f"mail u{i}@k.com call 555 {i:07d} or (030) {i:06d} "
    seconds = []
    for n in (12_500, 50_000):
        df = spark.createDataFrame([(1, "".join(map(line, range(n))))], "doc_id long, text string")
        start = time.monotonic()
        row = span_digests(pii_spans(df)).first()
        seconds.append(time.monotonic() - start)
        assert row["n_email"] == n
    assert seconds[1] < 60 and seconds[1] < 8 * max(seconds[0], 2.0)
