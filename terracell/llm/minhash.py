"""Near-duplicate classes by consistent weighted sampling of TF-IDF shingles.

Method
------
1. Shingles are runs of five words (a shorter text is one shingle).  Document frequencies of all shingles of all
   documents go into a count-min sketch of fixed size, so it may be sent to every task; its error is a fixed share of
   the number of documents, at any size of input.
2. A shingle weighs (1 + ln tf) * ln(1 + N / (N + df)).  The smoothing by N keeps a shingle that thousands of copies
   share close to the weight of a rare one, so near copies inside large groups still reach the threshold; only what a
   large share of all documents contains loses weight.
3. Each text gets 64 improved consistent weighted samples, in 16 bands of four.  Two texts of similarity 0.8 share a
   band with probability 0.9998.
4. Copies of one text are one node.  Within a bucket nodes are linked to the bucket's hub (the node with most company
   over all bands) and to their predecessor; large buckets are split by a salt first, and the hubs of the parts are
   linked in turn.  So the candidates grow with the rows, not with the square of a bucket.
5. Every candidate link is verified by the weighted Jaccard similarity of whole texts.  Verified links give classes;
   where a bucket still holds several classes, their representatives are compared in another order in further rounds,
   until a round finds no new link (or `rounds` is reached).  That only makes the last step small.
6. Nodes whose buckets still hold several classes are open.  A prefix filter finds every pair of open nodes of different
   classes that can reach the threshold: shingles are ordered from the rarest among open nodes, a similar pair shares
   one near the front of both texts, and the weight from there on bounds the similarity.  All these pairs are verified,
   so no similar pair that shares a bucket stays split.

Null and empty texts have no shingles and are near only to one another, as copies.  Rows without a doc_id stay alone.
Rows are told apart by their texts: rows that repeat an id have each the class of their own text, and a class is named
by its smallest doc_id.  An empty table gives an empty result; other columns are ignored.

Hot keys: a bucket's window is split into parts of PART nodes; copies and links are joined from written tables, so that
Spark splits a hot group or a giant class among tasks; counts and minima are combined before each shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, free_name, mix, texts, window_hashes, word_hashes
from .components import components

WORDS = 5
BANDS, ROWS = 16, 4
WIDTH = 1 << 18  # slots of each of the sketch's two rows
BLOCK = 1 << 14
#: A bucket with more nodes than this is split by a salt into parts of about this size.
PART = 2048


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of a text, as hashes, and how often each occurs."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(window_hashes(word_hashes(words), min(WORDS, len(words))), return_counts=True)


def _places(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (f & np.uint64(WIDTH - 1)).astype(np.int64), WIDTH + ((f >> np.uint64(24)) & np.uint64(WIDTH - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(2 * WIDTH, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for at in _places(shingles(text)[0]):
                np.add.at(held, at, 1)
    blocks = np.flatnonzero(held.reshape(-1, BLOCK).any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([held[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks], pa.binary())], names=["block", "held"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, held in zip(batch.column("block").to_pylist(), batch.column("held").to_pylist()):
            total[b] = total.get(b, 0) + np.frombuffer(held, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "held"])


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch (two rows of WIDTH counts) over all texts, and the number of rows."""
    schema = "block long, held binary"
    held, n = np.zeros(2 * WIDTH, np.int64), rows.count()
    # tasks add their own counts first; a reducer adds blocks of fixed length as they come
    for r in rows.mapInArrow(_count, schema).repartition("block").mapInArrow(_sum, schema).collect():
        held[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["held"], np.int64)
    return held, n


def idf_table(held: np.ndarray, n: int) -> np.ndarray:
    return np.log1p(n / (n + held.astype(np.float64))) if n else np.zeros(len(held))


def weigh(text: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and their weights.  The larger idf of a shingle's two slots belongs to the smaller, better count."""
    f, tf = shingles(text)
    a, b = _places(f)
    return f, (1 + np.log(tf)) * np.maximum(idf[a], idf[b])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of smaller weights over sum of larger ones."""
    f, back = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    x, y = np.bincount(back[: len(a[0])], a[1], len(f)), np.bincount(back[len(a[0]) :], b[1], len(f))
    top = np.maximum(x, y).sum()
    return float(np.minimum(x, y).sum() / top) if top else 0.0


def _gamma_quantiles(p: np.ndarray) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, by bisection of 1 - exp(-x) (1 + x)."""
    lo, hi = np.zeros(len(p)), np.full(len(p), 64.0)
    for _ in range(80):
        x = (lo + hi) / 2
        below = -np.expm1(-x) - x * np.exp(-x) < p
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    return (lo + hi) / 2


class _Sampler:
    """Improved consistent weighted sampling; the random variates of a shingle come from a hash of it."""

    def __init__(self) -> None:
        steps = 1 << 16
        edges = np.clip(np.arange(steps + 1) / steps, 2.0**-22, 1 - 2.0**-22)
        self.r = _gamma_quantiles((np.arange(steps) + 0.5) / steps).astype(np.float32)
        c = np.log(_gamma_quantiles(edges))
        self.c, self.dc = c[:-1].astype(np.float32), (np.diff(c) / steps).astype(np.float32)
        self.salts = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]

    def sample(self, f: np.ndarray, w: np.ndarray, width: int = 512) -> np.ndarray:
        """For each of the hash functions an identifier of the sampled (shingle, level)."""
        k = len(self.salts)
        best, ident, rows = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64), np.arange(k)
        log_w = np.log(w).astype(np.float32)
        for s in range(0, len(f), width):
            g = f[s : s + width]
            bits = mix(g[None, :] ^ self.salts).view(np.uint16).reshape(k, len(g), 4)
            r = np.take(self.r, bits[..., 0])
            beta = bits[..., 1] * np.float32(2.0**-16)
            t = np.floor(log_w[s : s + width] / r + beta)
            a = np.take(self.c, bits[..., 2]) + np.take(self.dc, bits[..., 2]) * bits[..., 3] - r * (t - beta + 1)
            at = a.argmin(axis=1)
            low = a[rows, at]
            better = low < best
            best[better] = low[better]
            ident[better] = mix(g[at] + t[rows, at].astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[better]
        return ident

    def bands(self, f: np.ndarray, w: np.ndarray) -> np.ndarray:
        ident = self.sample(f, w).reshape(BANDS, ROWS)
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(ROWS):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ident[:, j])
        return out.view(np.int64)


_sampler: list[_Sampler] = []


def sampler() -> _Sampler:
    if not _sampler:
        _sampler.append(_Sampler())
    return _sampler[0]


def _content() -> list:
    """A 128-bit hash of the text, in two columns."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), F.col("text")).alias("h2")]


def signatures(rows: DataFrame, idf) -> DataFrame:
    """doc_id, a 128-bit content hash (h1, h2), bands (null without shingles).  idf: a broadcast table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, seen = [], {}
            for text, *content in zip(*(batch.column(c).to_pylist() for c in ("text", "h1", "h2"))):
                content = tuple(content)
                if content not in seen:
                    f, w = weigh(text, idf.value)
                    seen[content] = sampler().bands(f, w).tolist() if len(f) else None
                bands.append(seen[content])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "bands"])

    return rows.select("doc_id", "text", *_content()).mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>")


def _nodes(signed: DataFrame) -> Written:
    """node, doc, h1, h2, bands of each different text; doc is its smallest id.

    A node is named by its doc; where texts share that id, all but one get names below all ids."""
    found = Written(signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.any_value("bands").alias("bands")), "contents")
    shared = Written(found.df.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h1", "h2")).alias("first")).filter("n > 1").select("doc", "first"), "shared")
    if not shared.df.limit(1).count():
        shared.drop()
        return Written(found.df.select(F.col("doc").alias("node"), "*"), "nodes")
    lowest = found.df.agg(F.min("doc")).first()[0]
    named = found.df.join(shared.df, "doc", "left").withColumn("other", F.col("first").isNotNull() & (F.struct("h1", "h2") != F.col("first")))
    below = F.lit(min(lowest, 0) - 1) - F.monotonically_increasing_id()  # fixed once it is written
    return Written(named.select(F.when(F.col("other"), below).otherwise(F.col("doc")).alias("node"), "doc", "h1", "h2", "bands"), "nodes")


def _candidates(members: DataFrame, order: F.Column) -> DataFrame:
    """Links (a, b) within buckets: members (band, key, doc, n, ...) to the first of their part in `order` and to the one
    before; the firsts of a bucket's parts likewise."""
    parts = members.withColumn("part", F.pmod(F.xxhash64("doc", F.lit(3)), F.ceil(F.col("n") / PART))).withColumn("order", order)
    own = Window.partitionBy("band", "key", "part").orderBy("order", "doc")
    inside = parts.select("band", "key", "order", "doc", F.first("doc").over(own).alias("hub"), F.lag("doc").over(own).alias("before"))
    whole = Window.partitionBy("band", "key").orderBy("order", "doc")
    hubs = inside.filter("doc = hub").select("doc", F.first("doc").over(whole).alias("hub"), F.lag("doc").over(whole).alias("before"))
    both = inside.select("doc", "hub", "before").union(hubs)
    pairs = both.select("doc", F.explode(F.array("hub", "before")).alias("other")).filter("doc <> other")
    return pairs.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def _verified(pairs: DataFrame, rows: DataFrame, idf, threshold: float) -> DataFrame:
    """pairs (a, b) with `similar`: whether their weighted Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        for batch in batches:
            cols, ok = {c: batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")}, []
            for a, b, ta, tb in zip(*cols.values()):
                if len(kept) > 64:
                    kept.clear()
                for i, t in ((a, ta), (b, tb)):
                    if i not in kept:
                        kept[i] = weigh(t, idf.value)
                ok.append(similarity(kept[a], kept[b]) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "similar"])

    named = lambda x: rows.select(F.col("doc").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similar boolean")


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """doc, label of the nodes that share a bucket with a node of another class."""
    classed = _classed(buckets, labels)
    several = classed.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band", "key")
    return classed.join(several, ["band", "key"]).select("doc", "label").distinct()


def _classed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    return buckets.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))


def _prefixes(rows: DataFrame, idf, counts, threshold: float) -> DataFrame:
    """The shingles f near the front of each text of rows (doc, label, text), rarest first by counts (a broadcast sketch):
    doc, label, the text's weight (total), its weight from f on (rest), and whether f still counts for the lighter text
    of a pair (lead).

    With texts a not heavier than b a similarity of t needs a common weight of 2t / (1 + t) of a's and t of b's, and all
    that is common lies in the rest of the first common shingle.  A shingle of one text only is left out."""
    t = threshold * (1 - 1e-9)
    names = ["f", "doc", "label", "total", "rest", "lead"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "label", "text"))):
                f, w = weigh(text, idf.value)
                a, b = _places(f)
                count = np.minimum(counts.value[a], counts.value[b])
                at = np.lexsort((f, count))
                f, w, count = f[at], w[at], count[at]
                rest = np.cumsum(w[::-1])[::-1]
                total = rest[0]
                kept = (rest >= t * total) & (count > 1)
                n = int(kept.sum())
                held.append((f[kept].view(np.int64), np.full(n, doc), np.full(n, label), np.full(n, total), rest[kept], rest[kept] >= 2 * t / (1 + t) * total))
                size += n
                if size > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=names)

    return rows.select("doc", "label", "text").mapInArrow(run, "f long, doc long, label long, total double, rest double, lead boolean")


def _across(rows: DataFrame, idf, threshold: float) -> Written:
    """All pairs (a, b) of rows (doc, label, text) with different labels that can reach the threshold.

    Of a shingle's rows those of its most frequent label meet only the others, so that the pairs looked at stay within
    twice those of different labels; the lighter side is split by a salt."""
    t = threshold * (1 - 1e-9)
    counts = rows.sparkSession.sparkContext.broadcast(document_frequencies(rows.select("text"))[0])
    marks = Written(_prefixes(rows, idf, counts, threshold), "prefixes")
    of_label = marks.df.groupBy("f", "label").agg(F.count(F.lit(1)).alias("n"), F.bool_or("lead").alias("lead"))
    of_shingle = of_label.groupBy("f").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("n", "label")).alias("top"), F.bool_or("lead").alias("any_lead"))
    shared = of_shingle.filter("labels > 1 AND any_lead").select("f", "top", F.ceil(F.col("n") / PART).alias("parts"))
    own = marks.df.join(shared, "f").withColumn("side", F.when(F.col("label") == F.col("top"), 0).otherwise(1))
    named = lambda df, x: df.select("f", "side", "part", *[F.col(c).alias(f"{c}_{x}") for c in ("doc", "label", "total", "rest")])
    light = named(own.filter("lead").withColumn("part", F.pmod(F.xxhash64("doc", F.lit(5)), F.col("parts"))), "a")
    met = F.when(F.col("side") == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    heavy = named(own.withColumn("side", F.explode(met)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))), "b")
    enough = F.least("rest_a", "rest_b") * (1 + t) >= t * (F.col("total_a") + F.col("total_b"))
    met = light.join(heavy, ["f", "side", "part"]).filter((F.col("label_a") != F.col("label_b")) & (F.col("total_a") <= F.col("total_b")) & enough)
    pairs = Written(met.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct(), "across")
    marks.drop()
    return pairs


def _labelled(docs: DataFrame, threshold: float, rounds: int) -> DataFrame:
    """doc_id, h1, h2, label, class_id of each row of docs that has an id; label names the class, class_id is the
    smallest doc_id in it."""
    spark = docs.sparkSession
    rows = texts(docs).filter("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    idf = spark.sparkContext.broadcast(idf_table(*document_frequencies(rows)))
    signed = Written(signatures(rows, idf), "signatures")
    # written, so that Spark may split a hot group of copies in the joins with it
    nodes = _nodes(signed.df)
    banded = nodes.df.select(F.col("node").alias("doc"), F.posexplode("bands").alias("band", "key"))
    sizes = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = Written(banded.join(sizes, ["band", "key"]), "buckets")
    company = buckets.df.groupBy("doc").agg(F.sum("n").alias("company"))

    pairs = Written(_candidates(buckets.df.join(company, "doc"), -F.col("company")), "pairs")
    # one text for each node that shares a bucket at all; later rounds read only these
    shared = nodes.df.join(buckets.df.select(F.col("doc").alias("node")).distinct(), "node", "left_semi").select("node", F.col("doc").alias("doc_id"), "h1", "h2")
    held = Written(rows.select("doc_id", "text", *_content()).join(shared, ["doc_id", "h1", "h2"]).dropDuplicates(["node"]).select(F.col("node").alias("doc"), "text"), "texts")
    tried = [Written(_verified(pairs.df, held.df, idf, threshold), "verified")]
    labels = None
    for turn in range(2, rounds + 2):
        all_tried = tried[0].df
        for t in tried[1:]:
            all_tried = all_tried.union(t.df)
        if labels:
            labels.drop()
        labels = components(all_tried.filter("similar"))
        if turn > rounds:
            break
        # one node stands for each class in a bucket
        classed = _classed(buckets.df, labels.df)
        heads = classed.groupBy("band", "key", "label").agg(F.min_by("doc", F.xxhash64("doc", F.lit(turn))).alias("doc"))
        several = heads.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        fresh = _candidates(heads.join(several, ["band", "key"]), F.xxhash64("doc", F.lit(turn))).join(all_tried.select("a", "b"), ["a", "b"], "left_anti")
        tried.append(Written(_verified(fresh, held.df, idf, threshold), "verified"))
        if not tried[-1].df.filter("similar").limit(1).count():
            break
    # whatever the rounds left: every pair of different classes in open buckets
    opened = Written(_open(buckets.df, labels.df), "open")
    if opened.df.limit(1).count():
        across = _across(held.df.join(opened.df, "doc"), idf, threshold)
        fresh = across.df.join(all_tried.select("a", "b"), ["a", "b"], "left_anti")
        tried.append(Written(_verified(fresh, held.df, idf, threshold), "verified"))
        across.drop()
        if tried[-1].df.filter("similar").limit(1).count():
            labels.drop()
            labels = components(all_tried.union(tried[-1].df).filter("similar"))
    of_node = nodes.df.join(labels.df, "node", "left").select("h1", "h2", "doc", F.coalesce("label", "node").alias("label"))
    named = Written(of_node, "classes")
    first = named.df.groupBy("label").agg(F.min("doc").alias("class_id"))
    own = signed.df.select("doc_id", "h1", "h2").join(named.df.join(first, "label").drop("doc"), ["h1", "h2"])
    out = Written(own.select("doc_id", "h1", "h2", "label", "class_id"), "labelled").df
    for t in (pairs, held, buckets, opened, labels, signed, nodes, named, *tried):
        t.drop()
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, rounds: int = 4) -> DataFrame:
    """doc_id, class_id, kept for each row of docs: class_id is the smallest doc_id of its class, kept marks that one."""
    out = _labelled(docs, threshold, rounds).select("doc_id", "class_id")
    alone = texts(docs).filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return out.union(alone).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each_class(docs: DataFrame, threshold: float = 0.8, rounds: int = 4) -> DataFrame:
    """One row of docs for each class, with all its columns: one with the smallest id.  Rows without an id all stay."""
    stays = _labelled(docs, threshold, rounds).filter("doc_id = class_id").groupBy("label").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("s"), F.count(F.lit(1)).alias("rows"))
    stays = Written(stays.select("s.*", "rows"), "stays").df
    # the rows of one id and text carry the same values here; names that docs cannot hold twice
    i, a, b = (free_name(c, docs.columns) for c in ("near_id", "near_h1", "near_h2"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn(i, F.col("doc_id").cast("long")).withColumn(a, F.xxhash64(text)).withColumn(b, F.xxhash64(F.lit(7), text))
    wanted = lambda of: stays.filter(of).select(F.col("doc_id").alias(i), F.col("h1").alias(a), F.col("h2").alias(b))
    kept = rows.join(wanted("rows = 1"), [i, a, b], "left_semi").unionByName(rows.filter(F.col(i).isNull()))
    if stays.filter("rows > 1").limit(1).count():
        kept = kept.unionByName(rows.join(wanted("rows > 1"), [i, a, b], "left_semi").dropDuplicates([i, a, b]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
