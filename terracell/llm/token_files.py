"""Token ids in compressed files: canonical length-limited Huffman blocks with bit-offset checkpoints.

File format
-----------
A folder with two Parquet tables, so that Spark's commit protocol and any shared store hold them:
  codebook  one row: the code length (0 to 16 bits) of every id; canonical codes follow from the lengths alone.
  blocks    one row for each independent block of whole documents: `part` and `block` give the order, `docs` and
            `sizes` the documents and their numbers of ids, `first` the ids of the part before the block, `bits` the
            codes of all ids, most significant bit first, and `checkpoints` the bit offset of every 128th id.

Writing: texts are encoded once and kept as 16- or 32-bit ids; global counts are summed per id before they reach the
driver (one row for each id of the vocabulary, at any size of input); rows are range-partitioned and sorted by doc_id.
Reading: the ids before a part come from a running sum over one row for each part; every block is decoded by itself.

Null texts count as empty and hold the end id alone.  A null doc_id sorts first; rows that repeat a doc_id stand next
to each other.  An empty table gives an empty codebook and no blocks; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, scratch_path, texts
from .huffman import Decoder, code_lengths, codes, encode
from .tokens import at_once, encoder

EVERY = 128
BLOCK = 1 << 18


def _encode_texts(path: str, end: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, False)
        for batch in batches:
            column = batch.column("text")
            ids = [np.append(x, end).astype(dtype).tobytes() for lo, hi in at_once(column) for x in enc.encode_unspaced(column.slice(lo, hi - lo))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _count_ids(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                c = np.bincount(np.frombuffer(raw, dtype))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return run


def _write_blocks(lengths: np.ndarray, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = codes(lengths), TaskContext.get().partitionId()
        first, block, docs, held = 0, 0, [], []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            bits, checkpoints = encode(ids.astype(np.int64), lengths, code, EVERY)
            row = [[part], [block], [first], [docs], [[len(x) for x in held]], [bits], [checkpoints.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()))], names=["part", "block", "first", "docs", "sizes", "bits", "checkpoints"])

        size = 0
        for batch in batches:
            for i, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(i)
                held.append(np.frombuffer(raw, dtype))
                size += len(held[-1])
                if size >= BLOCK:
                    yield close()
                    first, block, docs, held, size = first + size, block + 1, [], [], 0
        if held:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int, ids: int = 1 << 16) -> str:
    """Write the ids of docs under path, in ascending doc_id order; `end` closes each document; ids below `ids`."""
    dtype = "<u2" if ids <= 1 << 16 else "<u4"
    encoded = Written(texts(docs).mapInArrow(_encode_texts(tokenizer, end, dtype), "doc_id long, ids binary"), "ids")
    counted = encoded.df.mapInArrow(_count_ids(dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    ordered = encoded.df.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = ordered.mapInArrow(_write_blocks(lengths, dtype), "part int, block long, first long, docs array<long>, sizes array<long>, bits binary, checkpoints binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    encoded.drop()
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (array) of each document, decoded from the files."""
    return _read(spark, path, "doc_id long, start long, ids array<int>", lambda ids: pa.array(ids, pa.list_(pa.int32())))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
    crc = lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: pa.array([len(x) for x in ids], pa.int64()), crc)


def _read(spark: SparkSession, path: str, schema: str, *columns) -> DataFrame:
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"]), np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("n", F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))
    # one row for each range partition that was written; so the running sum and the broadcast stay small
    parts = spark.read.parquet(f"{path}/blocks").select("part", F.explode("sizes").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, names = Decoder(lengths), [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                ids = decoder.decode(row["bits"], np.frombuffer(row["checkpoints"], np.uint32), row["n"], EVERY)
                ends = np.cumsum(row["sizes"])
                each = np.split(ids, ends[:-1])
                start = row["before"] + row["first"] + ends - np.array(row["sizes"])
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(start, pa.int64()), *(f(each) for f in columns)], names=names)

    joined = blocks.join(F.broadcast(before), "part").select("before", "first", "docs", "sizes", "bits", "checkpoints", "n")
    return joined.mapInArrow(run, schema)


def token_file_digests(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Write docs to a new folder of the shared store and return what reading it gives."""
    spark = docs.sparkSession
    return token_digests(spark, write_token_files(docs, scratch_path(spark, "tokens"), tokenizer, end))
