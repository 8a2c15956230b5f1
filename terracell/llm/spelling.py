"""Spelling variants: words at one edit from a much more frequent word, by two-dimensional range reporting.

Words are counted over all whole texts: in each task by document, then by Spark.  Two words are near if one code point is
inserted, deleted or replaced.  Say m is the length of the longer one and i the place of the edit in it: then both
share their first i and their last m - 1 - i code points.  So with words sorted forward and backward, the words near to
one at place i are the points (forward rank, backward rank) in the rectangle of its prefix interval and its suffix
interval; a wavelet tree over the words of length m, in forward order with backward ranks as values, reports them.

Work is dealt out by what two near words must share: for places in the front half the back half, for places in the back half
the front half.  A word meets the words of its own length and, as the shorter one, those one longer.  A group of more words
than one task should hold is split by places, each half of which fixes a further part of the word, until it fits; a group for
one place has no more words than the alphabet has letters.  Tasks return counts and the most frequent partner of each word,
never pairs.

Null texts have no words, and a null doc_id counts as an empty string; rows that are repeated count repeatedly.  Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written
from .conversations import _CRC_TABLE, crc32_sql

#: Letters of a word as Latin-1 bytes, A to Z folded; everything else, and what Latin-1 lacks, is a gap.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Code points of the words of a group that one task indexes at a time; groups beyond are split.
GROUP_BYTES = 1 << 21
#: Different words that a task counts before it hands them on.
COUNTED = 200_000


def words_of(doc_id: int | None, text: str, damage: int = 199) -> Counter:
    """The words of a text with their counts, after the deletion of a code point where `damage` divides the hash."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in Counter(text.encode("latin-1", "replace").translate(_FOLDED).split()).items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % damage == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        out[w] += n
    return out


def word_counts(docs: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """word, n of the words of at least `shortest` code points and `least` occurrences."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for w, n in words_of(i, text).items():
                    if len(w) >= shortest:
                        held[w] += n
                if len(held) > COUNTED:
                    yield pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in held], "n": list(held.values())}, schema)
                    held.clear()
        yield pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in held], "n": list(held.values())}, schema)

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    return known.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# ---- groups of words that may be near


def _key(word: F.Column, m: F.Column, lo: F.Column, hi: F.Column) -> F.Column:
    """What words share that are near at a place lo <= i < hi of the longer one."""
    return F.concat(F.substring(word, F.lit(1), lo), F.lit(" "), F.when(hi < m, F.substring(word, F.length(word) - (m - hi) + 1, m - hi)).otherwise(""))


def _halves(rows: DataFrame) -> DataFrame:
    """rows once for each half of their places, with the key of the half."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    each = F.explode(F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))).alias("s")
    cut = rows.select("m", each, "word", "n").select("m", "s.lo", "s.hi", "word", "n")
    return cut.select("m", "lo", "hi", _key(F.col("word"), F.col("m"), F.col("lo"), F.col("hi")).alias("key"), "word", "n")


def candidate_groups(vocabulary: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """m, lo, hi, key, word, n: the words of each group; groups that are too large are split by places, a few rounds at most."""
    length = F.length("word")
    whole = vocabulary.select(F.explode(F.array(length, length + 1)).alias("m"), F.lit(0).alias("lo"), "word", "n").withColumn("hi", F.col("m"))
    open_, done = _halves(whole), None
    group = ["m", "lo", "hi", "key"]
    while True:
        hot = Written(open_.groupBy(*group).agg(F.count(F.lit(1)).alias("k")).filter((F.col("k") * F.col("m") > group_bytes) & (F.col("hi") - F.col("lo") > 1)).select(*group), "groups")
        if hot.df.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        small = open_.join(hot.df, group, "left_anti").select(*group, "word", "n")
        done = small if done is None else done.unionByName(small)
        open_ = _halves(open_.join(hot.df, group, "left_semi").select(*group, "word", "n"))


# ---- the index of one chunk of groups


class WaveletTree:
    """A permutation, of which report() gives all values inside rectangles of places and values, for many at once."""

    def __init__(self, values: np.ndarray):
        self.n, self.bits = len(values), max(1, int(len(values) - 1).bit_length()) if len(values) else 0
        self.zeros, self.split = [], []
        for k in reversed(range(self.bits)):
            bit = (values >> k) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(bit == 0)]))
            self.split.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of all points with start <= place < end and low <= value < high."""
        q = np.flatnonzero((start < end) & (low < high))
        s, e, v = start[q], end[q], np.zeros(len(q), np.int64)
        for level, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            width = 1 << (self.bits - 1 - level)  # values below a child
            s0, e0 = zeros[s], zeros[e]
            q, v = np.concatenate([q, q]), np.concatenate([v, v + width])
            s, e = np.concatenate([s0, split + s - s0]), np.concatenate([e0, split + e - e0])
            live = (s < e) & (v < high[q]) & (v + width > low[q])
            q, s, e, v = q[live], s[live], e[live], v[live]
        return q, v


def _intervals(shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each rank, the interval of ranks that share `length` letters; shared: letters shared with the rank before."""
    first = np.flatnonzero(shared < length)
    own = np.cumsum(shared < length) - 1
    return first[own], np.append(first[1:], len(shared))[own]


def _shared(letters: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Letters that each row shares with the row before it; -1 across groups."""
    differs = letters[1:] != letters[:-1]
    same = np.where(differs.any(1), differs.argmax(1), letters.shape[1])
    return np.concatenate([[-1], np.where(group[1:] == group[:-1], same, -1)])


def near_words(m: int, lo: int, hi: int, group: np.ndarray, words: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, how many words of its group are near to it at a place lo <= i < hi of the longer one, and which of
    them is the most frequent (the least of equals; -1 for none).  Words have m or m - 1 letters and are sorted by
    (group, word)."""
    rows = len(words)
    count, best = np.zeros(rows, np.int64), np.full(rows, rows, np.int64)
    size = np.fromiter(map(len, words), np.int64, rows)
    letters = np.frombuffer(b"".join(w.ljust(m, b"\0") for w in words), np.uint8).reshape(rows, m)
    backward = np.frombuffer(b"".join(w[::-1].ljust(m, b"\0") for w in words), np.uint8).reshape(rows, m)
    order = np.lexsort((np.ascontiguousarray(backward).view(f"S{m}").ravel(), group))
    rank = np.empty(rows, np.int64)
    rank[order] = np.arange(rows)
    long = size == m
    if not long.any():
        return count, np.full(rows, -1)
    forward_long, backward_long = np.concatenate([[0], np.cumsum(long)]), np.concatenate([[0], np.cumsum(long[order])])
    tree = WaveletTree(backward_long[rank[long]])
    of_value = order[long[order]]  # the word of each backward rank among the long ones
    ahead, behind = _shared(letters, group), _shared(backward[order], group[order])
    preference = np.empty(rows, np.int64)
    preferred = np.lexsort((np.arange(rows), -n))
    preference[preferred] = np.arange(rows)
    for i in range(lo, hi):
        start, end = _intervals(ahead, i)
        low, high = (x[rank] for x in _intervals(behind, m - 1 - i))
        start = forward_long[start]
        start = np.where(long, np.maximum(start, forward_long[1:]), start)  # two long words meet once, at the earlier one
        a, value = tree.report(start, forward_long[end], backward_long[low], backward_long[high])
        b = of_value[value]
        # a letter inserted into a run of itself fits several places; the last of them counts
        once = long[a] | (i == m - 1) | (letters[b, i] != letters[a, i])
        a, b = a[once], b[once]
        count += np.bincount(a, minlength=rows) + np.bincount(b, minlength=rows)
        np.minimum.at(best, a, preference[b])
        np.minimum.at(best, b, preference[a])
    return count, np.where(best < rows, preferred[np.minimum(best, rows - 1)], -1)


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _chunks(batches: Iterator[pa.RecordBatch], group_bytes: int) -> Iterator[tuple[tuple[int, int, int], list[str], list[str], list[int]]]:
    """Whole groups of the same places, together up to about the bound."""
    places, keys, words, counts = None, [], [], []
    for b in batches:
        for m, lo, hi, key, word, n in zip(*(b.column(c).to_pylist() for c in ("m", "lo", "hi", "key", "word", "n"))):
            if places != (m, lo, hi) or (keys and key != keys[-1] and len(words) * m > group_bytes // 2):
                if len(words) > 1:
                    yield places, keys, words, counts
                places, keys, words, counts = (m, lo, hi), [], [], []
            keys.append(key)
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        yield places, keys, words, counts


def near_counts(vocabulary: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """word, n_near, best_n, best (the most frequent near word, the least of equals) of each word that has near words."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (m, lo, hi), keys, words, counts in _chunks(batches, group_bytes):
            group = np.cumsum([False, *(a != b for a, b in zip(keys, keys[1:]))])
            n = np.array(counts)
            near, best = near_words(m, lo, hi, group, [w.encode("latin-1") for w in words], n)
            found = np.flatnonzero(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[k] for k in found], pa.string()), pa.array(near[found]), pa.array(n[best[found]]), pa.array([words[k] for k in best[found]], pa.string())], schema=_NEAR
            )

    dealt = candidate_groups(vocabulary, group_bytes).repartition("m", "lo", "hi", "key").sortWithinPartitions("m", "lo", "hi", "key", "word")
    each = dealt.mapInArrow(index, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("word")))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("_b")).select("word", "n_near", (-F.col("_b.k")).alias("best_n"), F.col("_b.word").alias("best"))


def roots(links: DataFrame) -> Written:
    """word, root of each row of links (word, form): forms followed to the last.  A form is at least five times as frequent
    as its word, so chains are short, and each round halves them."""
    now = Written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.df.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = Written(now.df.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now.drop()
        now, moved = new, new.df.filter("moved").limit(1).count()
        if not moved:
            return now


def spelling_variants(docs: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word; its form is its most frequent near word if that occurs `times` as
    often."""
    vocabulary = Written(word_counts(docs), "vocabulary").df
    near = near_counts(vocabulary)
    joined = vocabulary.join(near, "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    formed = Written(joined.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")), "forms").df
    ends = roots(formed.filter("form IS NOT NULL")).df.select("word", "root")
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
h AS (SELECT w, n, {crc32_sql("x", "t")} AS h FROM (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r), crc),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM x a JOIN v b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM x a JOIN v b ON a.rest = b.word),
b AS (SELECT word, count(*) AS n_near, arg_min({{'w': near, 'n': near_n}}, {{'k': -near_n, 'w': near}}) AS f FROM p GROUP BY word),
f AS (SELECT v.word, CASE WHEN f.n >= 5 * v.n THEN f.w END AS form, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN f.n >= 5 * v.n THEN f.n END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
c AS (SELECT word, word AS last, 0 AS k FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON c.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(last, k) AS root FROM c GROUP BY word) e ON f.word = e.word
"""
