import hashlib
import itertools
import random
import re
import zlib

import duckdb

from terracell.llm import conversations
from terracell.llm.common import table
from terracell.llm.conversations import ORACLE_SQL, SEGMENT, Trie, answered, chained, damaged, repair_digests, repaired, signatures

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
KEYS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def brute_edits(rows):
    """Cheapest (cost, audit, repaired rows) over all edit sequences of at most two insertions at each place."""
    best = None

    def grow(k, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for n in (0, 1, 2):
            for roles in itertools.product(("user", "assistant"), repeat=n):
                now = out + [(r, "") for r in roles]
                if k == len(rows):
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in now)):
                        found = (cost + 2 * n, audit + "I" * n, now)
                        best = found if best is None or found[:2] < best[:2] else best
                    continue
                role, text, fault = rows[k]
                grow(k + 1, cost + 2 * n + 3, audit + "I" * n + "D", now)
                if fault not in ("blank", "duplicate"):
                    more = cost + 2 * n + (fault == "truncated")
                    for other in (None, "user", "assistant"):
                        kept = now + [(other or role, text)]
                        if re.fullmatch("s?(ua)*u?", "".join(r[:1] or "?" for r, _ in kept)):
                            grow(k + 1, more + (2 if other else 0), audit + "I" * n + ("R" if other else "K"), kept)

    grow(0, 0, "", [])
    return best


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        inked = text.strip(" \t\n\v\f\r")
        out.append((role, text, "blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def brute(rows, originals):
    """conv_id: the digest columns, straight from the definition."""
    out = {}
    for conv in originals:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        marked, turns = faults([(r[2], r[3]) for r in own]), {r[1] for r in own} - {None}
        cost, audit, kept = brute_edits(marked) if marked else (0, "", [])
        count = [sum(f[2] == k for f in marked) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def random_rows(seed, conversations, most=6):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes.", "No", "  ", "", None, "Why? ", "x y z!", "a" * 300 + "."])
    return [(i if i else None, rng.choice([None, *range(5)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), text()) for i in range(conversations) for _ in range(rng.randrange(1, most))]


def test_against_all_edit_sequences(spark):
    rows = random_rows(3, 60)
    got = {r["conv_id"]: tuple(r[k] for k in KEYS) for r in repair_digests(damaged(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute(plain_damage(rows), {r[0] for r in rows})


def test_against_sql(spark):
    """The recursion over rows in SQL, on the given table and on odd rows."""
    for df in (table(spark, SF, "conversations"), spark.createDataFrame(random_rows(4, 80, 20), SCHEMA)):
        db = duckdb.connect()
        db.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
        db.execute("create view c as select conv_id::bigint as conv_id, turn::bigint as turn, role::varchar as role, text::varchar as text from conversations")
        found = db.execute(ORACLE_SQL.replace("FROM conversations", "FROM c"))
        names = [x[0] for x in found.description]
        want = {r[names.index("conv_id")]: tuple(r[names.index(k)] for k in KEYS) for r in found.fetchall()}
        assert {r["conv_id"]: tuple(r[k] for k in KEYS) for r in repair_digests(damaged(df)).collect()} == want


def test_segments_change_nothing(spark, monkeypatch):
    rows = random_rows(5, 40, 30)
    df = damaged(spark.createDataFrame(rows, SCHEMA))
    want = {r["conv_id"]: tuple(r) for r in repair_digests(df).collect()}
    monkeypatch.setattr(conversations, "SEGMENT", 3)
    got = repair_digests(df)
    assert {r["conv_id"]: tuple(r) for r in got.collect()} == want
    assert any(r["segment"] > 1 for r in answered(signatures(df)).collect())


def test_one_long_conversation(spark):
    """More rows than a segment holds; its repaired roles alternate."""
    n = 5 * SEGMENT + 7
    rows = [(1, t, "user" if t % 3 else "assistant", f"text {t}.") for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = repair_digests(df).first()
    out = repaired(df).orderBy("place").collect()
    assert [r["role"] for r in out] == ["user", "assistant"] * (len(out) // 2) and one["audit"].translate(str.maketrans("", "", "I")).count("D") + sum(bool(r["text"]) for r in out) == n
    assert one["repaired_sha256"] == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in out).encode()).hexdigest()
    trie = Trie()
    whole = chained([trie.answers("0" + "".join("u" if t % 3 else "a" for t in range(n)))])
    assert whole == (one["cost"], one["audit"])


def test_layers_are_shared():
    """Layers are computed for the nodes of the trie, not for the letters of all signatures."""
    words = sorted({"0" + "".join(w) for n in range(1, 7) for w in itertools.product("uad", repeat=n)})
    trie = Trie()
    for w in words + words[-1:]:
        trie.answers(w)
    assert trie.computed == len({w[:k] for w in words for k in range(2, len(w) + 1)})
    for w in words[::37]:
        assert Trie().answers(w) == [(p, q, c, e) for p, q, c, e in trie.answers(w)]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_digests(damaged(empty)).collect() == [] and repaired(empty).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", 1)], SCHEMA + ", cost int")
    assert [tuple(r) for r in repair_digests(damaged(df)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
