"""Substring deduplication with difference-cover anchors.

Method
------
A difference cover D modulo p holds residues such that every difference modulo p is one of two members of D.  So for
any two places i, j where the same `window` words start there is a shift t < p with both i + t and j + t at cover
positions, and the `window - p + 1` words from there lie inside the match: the anchor.

1. Anchors are hashed at cover positions only (6 of 31 places).  An anchor that occurs in two documents is shared.
2. Each shared anchor extends to the windows around it that contain it.  Those are hashed with 96 bits over all their
   words, and a window is a repeat if its hash also occurs in a document with a smaller doc_id.
3. Words under repeated windows are removed.

No pairs are formed.  In each Arrow batch rows of one hash are first reduced to the row of the smallest document; what
is already known to be shared or repeated goes its own way, so a hot passage sends a reducer one row for each batch.

Words are the runs of bytes between \\x20 and \\x09-\\x0D of the UTF-8 text, unchanged.  Null and empty texts have no words
and the hash of the empty string.  Rows without a doc_id neither lose words nor count as a source.  Rows of one doc_id give
one result each, whether their texts are equal or not: each is judged against documents with smaller ids, never against
the others of its own id.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, mix, texts, window_hashes, word_hashes

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31: each non-zero difference occurs exactly once.
COVER = (1, 5, 11, 24, 25, 27)
#: Stands for a null doc_id, so that all rows go through one shuffle of texts, which both joins then share.
NAMELESS = -(1 << 63)
#: Ids with several texts up to this many are broadcast.
BROADCAST_IDS = 500_000


def cover_positions(n: int) -> np.ndarray:
    """The cover positions below n."""
    at = np.add.outer(np.arange(0, n, PERIOD), np.array(COVER)).ravel()
    return at[at < n]


def _runs(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in `order`: the number of each row's run of equal keys, and where runs start."""
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    size = window - PERIOD + 1
    for batch in batches:
        ids, found, whose, where, rows = batch.column("doc_id").to_numpy(zero_copy_only=False), [], [], [], []
        for k, i in enumerate(np.argsort(ids, kind="stable")):
            words = batch.column("text")[i].as_py().split() if ids[i] != NAMELESS else []
            if len(words) < window:
                continue
            at = cover_positions(len(words) - size + 1)
            found.append(window_hashes(word_hashes(words), size, at=at))
            whose.append(np.full(len(at), ids[i], np.int64))
            where.append(at)
            rows.append(np.full(len(at), k))
        if not found:
            continue
        key, doc, pos, row = np.concatenate(found), np.concatenate(whose), np.concatenate(where), np.concatenate(rows)
        order = np.argsort(key, kind="stable")
        _, once = _runs(order, key, row)  # one place stands for all of a text under one hash
        order = order[once]
        run, first = _runs(order, key)
        doc, pos, key = doc[order], pos[order], key[order]
        last = np.append(first[1:], len(key)) - 1
        shared = (doc[first] != doc[last])[run]
        own = shared.copy()
        own[first] = False  # the smallest document stands for the batch under the anchor's hash
        key[own] = mix(mix(doc[own].astype(np.uint64)) + pos[own].astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(pos * 2 + shared)], names=["k", "doc_id", "place"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    size = window - PERIOD + 1
    reach = window - size
    for batch in batches:
        ids, parts = batch.column("doc_id").to_numpy(zero_copy_only=False), []
        for k, i in enumerate(np.argsort(ids, kind="stable")):
            words = batch.column("text")[i].as_py().split()
            n = len(words) - window + 1
            if n <= 0:
                continue
            h, cover = word_hashes(words), cover_positions(len(words) - size + 1)
            # places of all texts of this doc_id: those of another text may be too far, or open windows in vain
            shared = batch.column("at")[i].values.to_numpy(zero_copy_only=False)
            shared = shared[shared <= cover[-1]]
            key = window_hashes(h, size, at=cover)
            anchors = cover[np.isin(key, key[np.searchsorted(cover, shared)])]
            edge = np.zeros(len(words) + 2, np.int64)
            np.add.at(edge, np.maximum(anchors - reach, 0), 1)
            np.add.at(edge, np.minimum(anchors + 1, len(words) + 1), -1)
            at = np.flatnonzero(np.cumsum(edge)[:n])
            if len(at):
                parts.append((window_hashes(h, window, 0, at), window_hashes(h, window, 1, at).astype(np.uint32), np.full(len(at), ids[i], np.int64), at, np.full(len(at), k), np.full(len(at), batch.column("own")[i].as_py(), np.int64)))
        if not parts:
            continue
        w1, w2, doc, at, row, own = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(w1, kind="stable")
        run, first = _runs(order, w1, w2)
        known = np.empty(len(doc), bool)
        known[order] = doc[order] > doc[order][first][run]
        # more >= 0: a run of known repeats, `more` windows after the first; more < 0: -1 - more windows after the first
        # are equal to it and are judged with it
        a = np.flatnonzero(~known)
        rows = [(w1[:0], w2[:0], doc[:0], own[:0], at[:0], at[:0])]
        if len(a):
            new = np.ones(len(a), bool)
            new[1:] = (w1[a][1:] != w1[a][:-1]) | (w2[a][1:] != w2[a][:-1]) | (row[a][1:] != row[a][:-1]) | (at[a][1:] != at[a][:-1] + 1)
            s = np.flatnonzero(new)
            more = np.diff(np.append(s, len(a))) - 1
            rows.append((w1[a][s], w2[a][s], doc[a][s], own[a][s], at[a][s], -1 - more))
        if known.any():
            d, p, r = doc[known], at[known], row[known]
            start = np.ones(len(d), bool)
            start[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
            s = np.flatnonzero(start)
            e = np.append(s[1:], len(d)) - 1
            key = mix(mix(d[s].astype(np.uint64)) + p[s].astype(np.uint64))
            rows.append((key, np.zeros(len(s), np.uint32), d[s], own[known][s], p[s], p[e] - p[s]))
        k1, k2, d, own, lo, more = (np.concatenate(x) for x in zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int32)), pa.array(d), pa.array(own << 32 | lo), pa.array(more.astype(np.int32))],
            names=["k1", "k2", "doc_id", "at", "more"],
        )


def _spans_of(spans: pa.Scalar, key: int) -> np.ndarray:
    """The packed spans of the text with this key, of those of all texts of its doc_id."""
    own, packed = spans.values.field("own").to_numpy(zero_copy_only=False), spans.values.field("packed")
    parts = [packed[int(k)].values.to_numpy(zero_copy_only=False) for k in np.flatnonzero(own == key)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for i in range(batch.num_rows):
            words, spans = batch.column("text")[i].as_py().split(), batch.column("spans")[i]
            total, removed = len(words), 0
            packed = _spans_of(spans, batch.column("own")[i].as_py()) if spans.is_valid and total else ()
            if len(packed):
                edge = np.zeros(total + 1, np.int64)
                np.add.at(edge, packed >> 32, 1)
                np.add.at(edge, packed & 0xFFFFFFFF, -1)
                kept = np.cumsum(edge)[:total] == 0
                words = [w for w, k in zip(words, kept.tolist()) if k]
                removed = total - len(words)
            for x, v in zip(out, (total, removed, hashlib.sha256(b" ".join(words)).hexdigest())):
                x.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _packed_spans(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, spans: for each text of the id that has any, its key and an array of lo * 2^32 + hi (a struct for each span
    would take four times the room)."""
    anchors = rows.mapInArrow(lambda it: _anchors(it, window), "k long, doc_id long, place long")
    same = Window.partitionBy("k")
    shared = (
        anchors.select("doc_id", F.shiftright("place", 1).cast("int").alias("pos"), ((F.max(F.col("place") % 2).over(same) == 1) | (F.min("doc_id").over(same) < F.max("doc_id").over(same))).alias("is_shared"))
        .filter("is_shared")
        .groupBy("doc_id")
        .agg(F.collect_list("pos").alias("at"))
    )
    windows = rows.join(shared, "doc_id").mapInArrow(lambda it: _windows(it, window), "k1 long, k2 int, doc_id long, at long, more int")
    again = Window.partitionBy("k1", "k2")
    lo = F.col("at") % (1 << 32)
    hi = lo + F.lit(window) + F.when(F.col("more") < 0, -1 - F.col("more")).otherwise(F.col("more"))
    return (
        windows.select("doc_id", F.shiftright("at", 32).cast("int").alias("own"), (F.shiftleft(lo, 32) + hi).alias("span"), ((F.col("more") >= 0) | (F.min("doc_id").over(again) < F.col("doc_id"))).alias("repeat"))
        .filter("repeat")
        .repartition("doc_id")
        .groupBy("doc_id", "own")
        .agg(F.collect_list("span").alias("packed"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("own", "packed")).alias("spans"))
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, own, spans: array of (lo, hi) word ranges of docs that an earlier document also has; ranges may overlap.  There
    is a row for each different text of a doc_id that has any; `own` tells those of one id apart."""
    pair = lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("lo"), (x % (1 << 32)).cast("int").alias("hi"))
    each = _packed_spans(_bytes(docs), window).filter(F.col("doc_id") != NAMELESS).select("doc_id", F.explode("spans").alias("s"))
    return each.select("doc_id", "s.own", F.transform("s.packed", pair).alias("spans"))


def _bytes(docs: DataFrame) -> DataFrame:
    """doc_id, text, own: own is 0, or a number of the text where its doc_id has several texts.  Those ids are found from
    hashes alone and written; few of them (counted) are broadcast, so that texts are not shuffled for them."""
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NAMELESS)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    hashes = rows.select("doc_id", F.xxhash64("text").alias("h")).filter(F.col("doc_id") != NAMELESS).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    several = Written(hashes.filter("a <> b").select("doc_id", F.lit(True).alias("several")), "several").df
    n = several.count()
    if not n:
        return rows.withColumn("own", F.lit(0))
    own = F.when(F.col("several"), F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int")).otherwise(0)
    return rows.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "doc_id", "left").select("doc_id", "text", own.alias("own"))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs.  window is at least the cover's period."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    # the shuffle of texts by doc_id is the one that _packed_spans made: Spark reuses it
    rows = _bytes(docs)
    joined = rows.join(_packed_spans(rows, window), "doc_id", "left")
    out = joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NAMELESS)))
