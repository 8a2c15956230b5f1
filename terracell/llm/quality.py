"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its word unigrams and bigrams, hashed to 2^18 slots, in two families: the folded words (letters
in lower case without attached marks) and their written shapes (case class and attached marks), plus a slot for a word
that repeats the one before.  Each family is weighted by its share of the text, so length is no feature; a score is a
sparse dot product of slot weights and shares.

Training uses at most `max_rows` labelled rows (a documented bound: the rows with the smallest hash of their id), dealt
to eight shards.  Each shard runs FTRL-Proximal over its rows a few times, and the shards' weights are averaged; what
reaches the driver is eight weight vectors of fixed length.  Scoring reads every whole text.

Null texts count as empty: their score comes from the intercept.  Rows without a label, or whose document is missing,
do not train; repeated labels train repeatedly.  Without any training row nothing is known against a text and every
score is 1.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim_memory, mix, texts

SLOTS = 1 << 18
SHARDS = 8
#: Shares of the word and the shape family are multiplied by these.
WORD_SCALE, SHAPE_SCALE = 3.0, 6.0
#: Words, and bytes of words, whose features a Python worker keeps at a time.
KEPT_WORDS, KEPT_BYTES = 300_000, 24 << 20
#: Scores from here on predict a good text.
THRESHOLD = 0.7

_CORE = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


class _Words:
    """Feature hashes of words, kept between texts."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        self.number.clear()
        self.bytes, self.core, self.shape = 0, np.empty(1024, np.uint64), np.empty(1024, np.uint64)

    def _add(self, word: bytes) -> None:
        k = len(self.number)
        if k == len(self.core):
            self.core, self.shape = np.resize(self.core, 2 * k), np.resize(self.shape, 2 * k)
        text = word.decode("utf-8", "replace")
        m = _CORE.search(text)
        if m:
            body, marks = m[0], text[: m.start()][:3] + " " + text[m.end() :][:3]
            kind = "U" if body.isupper() and len(body) > 1 else "l" if body.islower() else "T" if body[0].isupper() else "d" if body[0].isdigit() else "m"
        else:
            body, marks, kind = text[:3], text[:3], "-"
        self.core[k] = xxhash.xxh3_64_intdigest(body.lower())
        self.shape[k] = xxhash.xxh3_64_intdigest(kind + marks)
        self.number[word] = k
        self.bytes += len(word)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        claim_memory("quality", self.forget)
        if len(self.number) > KEPT_WORDS or self.bytes > KEPT_BYTES:
            self.forget()
        for w in set(words).difference(self.number):
            self._add(w)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return self.core[at], self.shape[at]


_words = _Words()


def _family(h: np.ndarray, salt: int) -> list[np.ndarray]:
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    return [((mix(x + np.uint64(salt + k))) & np.uint64(SLOTS - 1)).astype(np.int64) for k, x in enumerate((h, pairs))]


def slots(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the word family and of the shape family, with repeats."""
    core, shape = _words.of(text)
    again = np.zeros(int((core[1:] == core[:-1]).sum()), np.int64)
    return np.concatenate(_family(core, 1)), np.concatenate([*_family(shape, 11), again])


def share(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sparse vector of a text: different slots and their weighted shares."""
    parts = [(s, np.full(len(s), scale / len(s))) for s, scale in zip(slots(text), (WORD_SCALE, SHAPE_SCALE)) if len(s)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    at, back = np.unique(np.concatenate([s for s, _ in parts]), return_inverse=True)
    return at, np.bincount(back, np.concatenate([v for _, v in parts]))


def train_shard(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], passes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> np.ndarray:
    """FTRL-Proximal over the rows, sparse vectors (share) with labels, in order; the last weight is the intercept."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        big = np.abs(z[at]) > l1
        return np.where(big, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(passes):
        for (at, x), y in rows:
            at, x = np.append(at, SLOTS), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(SLOTS + 1))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as sparse vectors, so that no shard holds texts."""
    for b in batches:
        found = [share(t or b"") for t in b.column("text").to_pylist()]
        at, x = (pa.array([v.astype(kind).tobytes() for v in part], pa.binary()) for part, kind in ((([a for a, _ in found]), np.int32), (([x for _, x in found]), np.float64)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("shard"), at, x], ["doc_id", "y", "shard", "at", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 24_000, passes: int = 4, label_col: str = "quality") -> np.ndarray | None:
    """Weights learnt from labels (doc_id, label_col in 0/1); None without labelled rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)  # bounded, so it may be broadcast
    rows = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SHARDS)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort([xxhash.xxh3_64_intdigest(str(i)) for i in pdf["doc_id"]], kind="stable")]
        w = train_shard([((np.frombuffer(a, np.int32), np.frombuffer(x)), y) for a, x, y in zip(pdf["at"], pdf["x"], pdf["y"])], passes)
        return pd.DataFrame({"rows": [len(pdf)], "weights": [w.astype(np.float32).tobytes()]})

    vectors = rows.select("doc_id", "y", "shard", "text").mapInArrow(_vectors, "doc_id long, y int, shard long, at binary, x binary")
    fitted = vectors.groupBy("shard").applyInPandas(fit, "rows long, weights binary").collect()
    if not fitted:
        return None
    return np.average([np.frombuffer(r["weights"], np.float32) for r in fitted], axis=0, weights=[r["rows"] for r in fitted]).astype(np.float32)


def score_text(text: bytes, weights: np.ndarray) -> float:
    total = float(weights[SLOTS])
    for s, scale in zip(slots(text), (WORD_SCALE, SHAPE_SCALE)):
        if len(s):
            total += scale * float(weights[s].mean(dtype=np.float64))
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def score_column(spark: SparkSession, weights: np.ndarray | None, text: F.Column) -> F.Column:
    """The score of each text, as a column, so that rows need not be joined to their scores."""
    if weights is None:
        return F.lit(1.0)
    model = spark.sparkContext.broadcast(weights)  # 2^18 + 1 floats at any size of input

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array([score_text(t or b"", model.value) for t in column.to_pylist()], pa.float64())

    return scored(text.cast("binary"))


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id, score of each row of docs."""
    return texts(docs).select("doc_id", score_column(docs.sparkSession, weights, F.col("text")).alias("score"))


def held_out(doc_id) -> F.Column:
    """Rows that never train: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_open(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Weights from the labels that are not held out."""
    return train(docs, labels.filter(~held_out(F.col("doc_id"))))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, learnt from labels that are not held out."""
    return score(docs, train_open(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns; no shuffle of texts."""
    return docs.filter(score_column(docs.sparkSession, train_open(docs, labels), F.col("text")) >= threshold)
