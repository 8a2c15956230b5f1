"""Exact deduplication through an extendible-hash index kept in shared files.

Method
------
1. Every row posts the 64-bit key of its text.  Postings are pre-aggregated by key (rows, largest id) without texts.
2. The directory starts shallow and doubles: keys are counted for each prefix of the current depth, what fits is a
   bucket, and an overfull one is split on the next bit, until each bucket holds at most `bucket_rows` keys.  A bucket
   is named by the first key of its range, and the directory is a table of (bucket, local_depth), never collected; only
   the list of depths in use reaches the driver.
3. Owner tasks hold ranges of buckets and decide.  A key with one row is a chain of one link.  Where a key repeats, the
   texts under it are compared byte by byte (copies are combined in the map tasks, so a hot group leaves each as one
   row): every different text becomes one link of the key's collision chain, with the largest id and the number of rows.
4. A row probes by its key: the directory gives the bucket, bucket and key give the chain.  A chain of one link decides
   at once, as all texts under the key are equal; in a longer one the row's bytes are compared with those of each link.

Tables that may be small are broadcast only up to BROADCAST rows, counted before; beyond that they are joined by
shuffle.  Groups of more than rows / BROADCAST copies are fewer than BROADCAST at any size, so those are always
broadcast, and no shuffled key of the probe holds more than that share of the rows.

Only DataFrame functions are used.  Null text counts as empty; rows that repeat an id count in the group and share its
decision; a null id is never preferred to another one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, free_name, texts

BUCKET_ROWS = 4096
#: Most rows of a broadcast table (a few numbers each).
BROADCAST = 50_000

Key = Callable[[Column], Column]


def bucket_at(key: Column, depth: int) -> Column:
    """The first key of the range of keys that share the first `depth` bits."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftleft(F.shiftrightunsigned(key, 64 - depth), 64 - depth)


def directory(keys: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, list[int]]:
    """(bucket, local_depth) of each bucket over the different keys of `keys`, and the depths in use."""
    n = keys.count()
    depth = max(0, int(math.log2(max(1, n / bucket_rows))))
    todo, settled, depths = keys.select("key"), None, []
    while True:
        held = Written(todo.groupBy(bucket_at(F.col("key"), depth).alias("bucket")).agg(F.count(F.lit(1)).alias("held")), "buckets").df
        fit = held.filter(F.col("held") <= bucket_rows).select("bucket", F.lit(depth).alias("local_depth"))
        settled = fit if settled is None else settled.union(fit)
        counts = held.agg(F.count_if(F.col("held") <= bucket_rows), F.count_if(F.col("held") > bucket_rows)).first()
        if counts[0]:
            depths.append(depth)
        if not counts[1]:
            return settled, depths
        over = held.filter(F.col("held") > bucket_rows).select("bucket")
        todo = todo.withColumn("bucket", bucket_at(F.col("key"), depth)).join(over, "bucket", "left_semi").select("key")
        depth += 1  # a bucket of one key fits, so that this ends at 64 at the latest


@dataclass
class Index:
    """The index in the shared folder.

    buckets: bucket, local_depth.  entries: bucket, local_depth, key, chain, chain_length, keep_id, group_size.
    chains: key, text, keep_id, group_size for the links of chains longer than one."""

    buckets: DataFrame
    depths: list[int]
    entries: DataFrame
    chains: DataFrame | None
    key: Key
    rows: int

    def located(self, rows: DataFrame) -> DataFrame:
        """rows (key, ...) with the bucket and local_depth that the directory gives."""
        ways = F.array(*[F.struct(bucket_at(F.col("key"), d).alias("bucket"), F.lit(d).alias("local_depth")) for d in self.depths])
        tried = rows.withColumn("way", F.explode(ways)).select(*rows.columns, "way.bucket", "way.local_depth")
        return tried.join(bounded(self.buckets), ["bucket", "local_depth"])

    def hot(self) -> Column:
        """Whether an entry's group is among those that are always broadcast: fewer than BROADCAST, whatever the input."""
        return F.col("group_size") > self.rows / BROADCAST


def bounded(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has at most BROADCAST rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _links(rows: DataFrame) -> DataFrame:
    """The different texts under each key of rows (key, text, doc_id), told apart by their bytes."""
    return rows.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def build_index(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, key: Key = F.xxhash64) -> Index:
    """The index of all rows of docs."""
    rows = texts(docs).select("doc_id", "text", key(F.col("text")).alias("key"))
    keys = Written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id")), "keys").df
    total = keys.agg(F.sum("n")).first()[0] or 0
    buckets, depths = directory(keys, bucket_rows)
    index = Index(buckets, depths or [0], keys, None, key, total)

    repeated = keys.filter("n > 1").select("key")
    if repeated.limit(BROADCAST + 1).count() <= BROADCAST:
        single = keys.filter("n = 1").select("key", "keep_id", F.col("n").alias("group_size"))
        links = _links(rows.join(F.broadcast(repeated), "key", "left_semi")).select("key", "keep_id", "group_size").union(single)
    else:  # too many to tell the rows of repeated keys apart beforehand
        links = _links(rows).select("key", "keep_id", "group_size")
    chain = Window.partitionBy("bucket", "key")
    owned = (
        index.located(links)
        .repartitionByRange("bucket", "key")
        .withColumn("chain", F.row_number().over(chain.orderBy("keep_id", "group_size")))
        .withColumn("chain_length", F.count(F.lit(1)).over(chain))
    )
    index.entries = Written(owned.select("bucket", "local_depth", "key", "chain", "chain_length", "keep_id", "group_size"), "index").df
    shared = index.entries.filter("chain_length > 1").select("key").distinct()
    if shared.limit(1).count():
        index.chains = Written(_links(rows.join(bounded(shared), "key", "left_semi")), "chains").df
    return index


def probe(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs that the index finds."""
    rows = texts(docs).select("doc_id", "text", index.key(F.col("text")).alias("key"))
    digest = F.sha2("text", 256).alias("text_sha256")
    narrow = Written(index.located(rows.select("doc_id", "key", digest)), "probe").df
    at, sole = ["bucket", "local_depth", "key"], index.entries.filter("chain_length = 1").drop("chain", "chain_length")
    hot = F.broadcast(sole.filter(index.hot()))
    found = narrow.join(hot, at).unionByName(narrow.join(hot, at, "left_anti").join(sole.filter(~index.hot()), at))
    out = found.select("doc_id", "keep_id", "group_size", "text_sha256")
    if index.chains is not None:
        keys = bounded(index.chains.select("key").distinct())
        chained = rows.select("doc_id", "key", "text", digest).join(keys, "key", "left_semi").join(index.chains, ["key", "text"])
        out = out.union(chained.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, key: Key = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs; of equal texts the largest id stays."""
    return probe(docs, build_index(docs, bucket_rows, key))


def without_copies(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, key: Key = F.xxhash64) -> DataFrame:
    """One row of each different text, with all its columns: one that has the largest id, or no id where none has one.

    Rows whose text occurs once stay where they are; texts are shuffled only where the copied keys are too many to be
    broadcast, and then without the hot ones."""
    index = build_index(docs, bucket_rows, key)
    k, keep, body = (free_name(c, docs.columns) for c in ("dedup_key", "dedup_keep", "dedup_text"))
    rows = docs.withColumn(body, F.coalesce("text", F.lit(""))).withColumn(k, key(F.col(body)))
    stays = F.col("doc_id").cast("long").eqNullSafe(F.col(keep))
    copied = index.entries.filter("chain_length = 1 AND group_size > 1").select(F.col("key").alias(k), F.col("keep_id").alias(keep), F.lit(True).alias(body + "_"), "group_size")
    decided = lambda some: some.filter(F.col(body + "_").isNull() | stays).drop(keep, body + "_")
    single, parts = rows, []
    if index.chains is not None:
        chains = index.chains.select(F.col("key").alias(k), F.col("text").alias(body), F.col("keep_id").alias(keep))
        keys = bounded(chains.select(k).distinct())
        parts.append(rows.join(keys, k, "left_semi").join(chains, [k, body]).filter(stays).drop(keep))
        single = rows.join(keys, k, "left_anti")
    if copied.limit(BROADCAST + 1).count() <= BROADCAST:
        parts.append(decided(single.join(F.broadcast(copied.drop("group_size")), k, "left")))
    else:
        hot = F.broadcast(copied.filter(index.hot()).drop("group_size"))
        parts.append(decided(single.join(hot, k)))
        parts.append(decided(single.join(hot, k, "left_anti").join(copied.filter(~index.hot()).drop("group_size"), k, "left")))
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.unionByName(part)

    # rows that repeat both id and text: one of them stays
    twins = Written(rows.groupBy(k, F.col("doc_id").alias(keep)).count().filter("count > 1").select(k, keep), "twins").df
    if twins.limit(1).count():
        few, same = bounded(twins), (kept[k] == twins[k]) & kept["doc_id"].eqNullSafe(twins[keep])
        alike = kept.join(few, same, "left_semi").dropDuplicates([k, body, "doc_id"])
        kept = kept.join(few, same, "left_anti").unionByName(alike)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
