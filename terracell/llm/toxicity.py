"""Toxicity: multiple-instance learning.  A document is a bag of sentences; only documents carry labels.

A sentence ends at a mark `.!?` or a line end.  Its features are its different words in lower case and their first four
and five letters (so that inflected forms meet), hashed to 2^18 slots; its own probability is p = sigmoid(b + w x).  A
document is toxic if any sentence is (noisy-or): P = 1 - prod(1 - p).  The gradient of the document's log-likelihood
reaches each sentence as p (1 - y / P), so that the sentences that explain a label take its blame, and the trained
sentence scores name the offending sentences.

Training uses at most `max_rows` labelled rows (a documented bound: those with the smallest hash of their id), turned
into slots before anything is written.  Slots whose presence in a document says nothing about its label (a likelihood
ratio below `least`) get no weight, or rare words would learn the labels by heart.  The others are trained by adaptive
gradient steps: in each round every partition of the written features adds up its gradient, and the driver adds those
vectors, of at most 2^18 numbers for each of a few partitions.  Scoring reads every whole text.

Null and empty texts, and texts without words, hold no sentence: their score is 0.  Rows without a label, or whose
document is missing, do not train; repeated labels train repeatedly.  Without any training row every score is 0.  An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, claim_memory, texts

SLOTS = 1 << 18
#: Words, and bytes of words, whose features a Python worker keeps at a time.
KEPT_WORDS, KEPT_BYTES = 300_000, 24 << 20
#: Scores from here on predict a toxic document; sentences from here on are named as offending.
THRESHOLD, OFFENDING = 0.7, 0.5
#: Weights before training: a sentence without known words is hardly ever toxic.
FIRST_BIAS = -6.0

_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")


class _Words(dict):
    """Numbers of words as written (0 for sentence ends), with the three slots of each; an unknown word gets its own."""

    def __init__(self) -> None:
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update({m: 0 for m in ".!?\n"})
        self.slots, self.used, self.bytes = np.full((1024, 3), SLOTS, np.int32), 1, 0

    def __missing__(self, word: str) -> int:
        k = self.used
        if k == len(self.slots):
            self.slots = np.concatenate([self.slots, np.full_like(self.slots, SLOTS)])
        folded = word.lower()
        for j, part in enumerate([folded, *(f"{folded[:n]}*" for n in (4, 5) if len(folded) >= n)]):
            self.slots[k, j] = xxhash.xxh3_64_intdigest(part) % SLOTS
        self[word], self.used = k, k + 1
        self.bytes += len(word)
        return k

    def numbers(self, tokens: list[str]) -> np.ndarray:
        claim_memory("toxicity", self.forget)
        if self.used > KEPT_WORDS or self.bytes > KEPT_BYTES:
            self.forget()
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


_words = _Words()


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sentence (from 0, of those with words) and slots of each different word of each sentence."""
    at = _words.numbers(_TOKEN.findall(text))
    ends = at == 0
    pairs = np.unique((np.cumsum(ends) << 32 | at)[~ends])
    sentence = pairs >> 32
    first = np.concatenate([[False], sentence[1:] != sentence[:-1]]) if len(sentence) else np.empty(0, bool)
    return np.cumsum(first, dtype=np.int32), _words.slots[pairs & 0xFFFFFFFF]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sentence_logits(sentence: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """weights: a weight for each slot, 0 for the slot of an absent part, and the intercept."""
    return weights[SLOTS + 1] + np.bincount(sentence, weights[slots].sum(1, dtype=np.float64)) if len(sentence) else np.empty(0)


def noisy_or(logits: np.ndarray) -> float:
    return float(-np.expm1(-_softplus(logits).sum()))


def gradient(rows: list[tuple[int, int, np.ndarray, np.ndarray]], weights: np.ndarray, bias: float) -> np.ndarray:
    """Gradient of the summed negative log-likelihood by weights and bias; rows (label, sentences, and for each feature its
    sentence and its place in weights)."""
    out = np.zeros(len(weights) + 1)
    for y, n, sentence, at in rows:
        if not n:
            continue
        z = bias + np.bincount(sentence, weights[at], minlength=n)
        own = 1 / (1 + np.exp(-np.clip(z, -30, 30))) * (1 - y / max(noisy_or(z), 1e-12))
        np.add.at(out, at, own[sentence])
        out[-1] += own.sum()
    return out


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bags = [bag(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("y"), pa.array([s.tobytes() for s, _ in bags], pa.binary()), pa.array([x.tobytes() for _, x in bags], pa.binary())], ["doc_id", "y", "sentence", "slots"]
        )


def _informative(bags: DataFrame, least: float) -> np.ndarray:
    """Slots whose presence in a bag and whose absence tell its label, by the likelihood ratio statistic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SLOTS + 1), np.int64)  # the last one counts bags
        for b in batches:
            for y, x in zip(b.column("y").to_pylist(), b.column("slots").to_pylist()):
                seen[int(y > 0), np.append(np.unique(np.frombuffer(x, np.int32)), SLOTS)] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int32()), "good": seen[0, at], "bad": seen[1, at]})

    counted = bags.select("y", "slots").mapInArrow(count, "slot int, good long, bad long").groupBy("slot").agg(F.sum("good").cast("double").alias("good"), F.sum("bad").cast("double").alias("bad"))
    whole = counted.filter(F.col("slot") == SLOTS).select(F.col("good").alias("all_good"), F.col("bad").alias("all_bad"))
    has, n = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad")
    term = lambda seen, of, share: F.when(seen > 0, seen * F.ln(seen * n / (of * share))).otherwise(0.0)
    cells = [term(F.col(k), F.col(f"all_{k}"), has) + term(F.col(f"all_{k}") - F.col(k), F.col(f"all_{k}"), n - has) for k in ("good", "bad")]
    told = counted.filter(F.col("slot") < SLOTS).crossJoin(F.broadcast(whole)).filter(2 * (cells[0] + cells[1]) >= least)
    return np.sort(told.select("slot").toPandas()["slot"].to_numpy(np.int64))  # at most 2^18


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 24_000, rounds: int = 30, partitions: int = 8, least: float = 12.0, rate: float = 1.0, l2: float = 0.05, label_col: str = "toxic") -> np.ndarray | None:
    """Weights learnt from labels (doc_id, label_col in 0/1); None without labelled rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)  # bounded, so it may be broadcast
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    features = rows.mapInArrow(_feature_batches, "doc_id long, y int, sentence binary, slots binary")
    bags = Written(features.repartition(partitions, F.xxhash64("doc_id", F.lit(7))), "bags")
    if bags.df.isEmpty():
        bags.drop()
        return None
    kept = _informative(bags.df, least)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for y, s, x in zip(*(b.column(k).to_pylist() for k in ("y", "sentence", "slots"))):
                sentence, x = np.frombuffer(s, np.int32), np.frombuffer(x, np.int32).reshape(-1, 3)
                at = np.searchsorted(kept, x)
                has = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == x) if len(kept) else np.zeros(x.shape, bool)
                own = np.repeat(sentence, 3).reshape(-1, 3)[has]
                out.append({"y": y, "n": int(sentence[-1]) + 1 if len(sentence) else 0, "sentence": own.astype(np.int32).tobytes(), "at": at[has].astype(np.int32).tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("y", pa.int32()), ("n", pa.int32()), ("sentence", pa.binary()), ("at", pa.binary())]))

    few = Written(bags.df.mapInArrow(narrow, "y int, n int, sentence binary, at binary"), "kept")
    bags.drop()
    weights, bias, seen = np.zeros(len(kept)), FIRST_BIAS, np.zeros(len(kept) + 1)
    for _ in range(rounds):

        def add_up(batches: Iterator[pa.RecordBatch], weights=weights, bias=bias) -> Iterator[pa.RecordBatch]:
            rows = ((y, n, np.frombuffer(s, np.int32), np.frombuffer(x, np.int32)) for b in batches for y, n, s, x in zip(*(b.column(k).to_pylist() for k in range(4))))
            yield pa.RecordBatch.from_pydict({"g": [gradient(rows, weights, bias).tobytes()]})

        parts = few.df.mapInArrow(add_up, "g binary").collect()
        g = np.sum([np.frombuffer(r["g"]) for r in parts], axis=0) + l2 * np.append(weights, 0.0)
        seen += g * g
        step = rate * g / (1e-3 + np.sqrt(seen))
        weights, bias = weights - step[:-1], bias - float(step[-1])
    few.drop()
    out = np.zeros(SLOTS + 2, np.float32)
    out[kept], out[SLOTS + 1] = weights, bias
    return out


def judge(text: str, weights: np.ndarray, threshold: float = THRESHOLD) -> tuple[float, list[tuple[int, int, float]]]:
    """The score of a text and, if it reaches the threshold, its offending sentences as (start, end, probability): those
    that are probably toxic, and the likeliest one in any case."""
    z = sentence_logits(*bag(text), weights)
    score = noisy_or(z)
    if score < threshold or not len(z):
        return score, []
    spans, start, end = [], None, 0
    for m in _TOKEN.finditer(text):
        if m[0] not in ".!?\n":
            start, end = m.start() if start is None else start, m.end()
        elif start is not None:
            spans.append((start, end))
            start = None
    if start is not None:
        spans.append((start, end))
    p = 1 / (1 + np.exp(-z))
    return score, [(s, e, float(q)) for (s, e), q in zip(spans, p) if q >= min(OFFENDING, p.max())]


_JUDGED = "struct<score: double, offending: array<struct<start: int, end: int, p: double>>>"


def judged(spark: SparkSession, weights: np.ndarray | None, text: F.Column, threshold: float = THRESHOLD) -> F.Column:
    """score and offending sentences of each text, as a column, so that rows need not be joined to their scores."""
    if weights is None:
        return F.from_json(F.lit('{"score": 0.0, "offending": []}'), _JUDGED)
    model = spark.sparkContext.broadcast(weights)  # 2^18 + 2 floats at any size of input
    kind = pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))])

    @F.arrow_udf(_JUDGED)
    def scored(column: pa.Array) -> pa.Array:
        found = [judge(t or "", model.value, threshold) for t in column.to_pylist()]
        return pa.array([{"score": s, "offending": [{"start": a, "end": b, "p": p} for a, b, p in o]} for s, o in found], kind)

    return scored(text)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that never train: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxic_sentences(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences (start, end, p) of each row of docs, learnt from
    labels that are not held out; places are code points, end exclusive."""
    weights = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = texts(docs).select("doc_id", judged(docs.sparkSession, weights, F.col("text"), threshold).alias("j"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("j.score").alias("score"), (F.col("j.score") >= threshold).cast("int").alias("predicted"), F.col("j.offending").alias("offending"))


def toxicity_digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic_sentences with the places of the offending sentences as one string."""
    return toxic_sentences(docs, labels).withColumn("offending", F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ","))
