"""Shared pieces of the corpus operators: the shared folder, written tables, words and hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text) of docs, null text as empty; so columns with clashing names never meet."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores appended until no column has it (Spark's names ignore case)."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and the master is local,
    a folder beside the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/terracell/{uuid.uuid4().hex}/{name}"


class Written:
    """A DataFrame written as Parquet in the shared folder: lineage ends there, lost executors re-read it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Only once nothing reads the table any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_memory: list = [None, None]


def claim_memory(owner: object, forget: Callable[[], None]) -> None:
    """What a Python worker remembers between texts belongs to one operator at a time: when another one's task begins, what
    the last one kept is forgotten.  Workers live on from stage to stage, and so would all their memories."""
    if _memory[0] != owner:
        if _memory[1] is not None:
            _memory[1]()
        _memory[:] = [owner, forget]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and products of hashes have no structure left."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Odd multipliers of the two window hashes, and the inverse of each modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them (kept for later calls)."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        base = _BASES[which]
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[which] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[which]


def window_hashes(hashes: np.ndarray, size: int, which: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of `size` words, or of those that start at the given places (prefix sums, no loop over words)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(which, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum((hashes if which == 0 else mix(hashes)) * up[: len(hashes)], out=sums[1:])
    if at is None:
        return mix((sums[size:] - sums[:n]) * down[:n])
    return mix((sums[at + size] - sums[at]) * down[at])
