"""Mixing sources to target weights by Poisson replication.

Method
------
Every source s has a target weight w_s; by default the square root of its number of rows, so that large sources lend
room to small ones.  Weights are normalised, and the rate of a source is w_s * total / n_s, the mean number of times
each of its rows is repeated (total: the rows of the result on average, by default as many as there are).  Each row
draws its count from the Poisson distribution of that mean by inversion: a uniform number comes from a hash of the
seed and the doc_id, and the count is the number of steps of the cumulative distribution that lie at or below it.
A rate above MAX_MEAN is the sum of ceil(rate / MAX_MEAN) independent draws of equal means, each with its own hash, so
counts are Poisson at every rate.  Rows are exploded by their counts and put in a global order by a hash of seed,
doc_id and copy.

The ladder of cumulative probabilities is computed once for each source.  Counts of rows per source are pre-aggregated,
and sources are few against rows: their table is broadcast when it has at most `broadcast_rows` rows, else joined by
shuffle, which Spark splits where a source is hot.  The order is a uniform hash, so its first digits give the
partition, and no pass is needed to sample bounds.

A null source is a source of its own, named ''.  Rows that repeat a doc_id draw the same count.  A null doc_id draws
like the id ''.  Columns of docs keep their values whatever their names; the four results are mix_source, mix_copy and
mix_order, with underscores appended where docs has such a column.  Sources without a given weight get none of their
rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Steps of the cumulative distribution that are looked at.
STEPS = 64
#: One draw has at most this mean (its tail beyond STEPS is below 2^-52); a higher rate is split over several draws.
MAX_MEAN = 16.0


def _uniform(*parts) -> F.Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5 hash."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """mix_source, rows, mix_rate of each source.  weights: (source, weight) with non-negative weights."""
    counts = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("mix_source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weighted = counts.withColumn("weight", F.sqrt(F.col("rows").cast("double")))
    else:
        given = weights.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("mix_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        weighted = counts.join(given, "mix_source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sums = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("rows").alias("all_rows"))
    wanted = F.lit(float(total)) if total is not None else F.col("all_rows").cast("double")
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    return weighted.crossJoin(F.broadcast(sums)).select("mix_source", "rows", (share * wanted / F.col("rows")).alias("mix_rate"))  # sums: one row


def ladder(rate: F.Column) -> F.Column:
    """draws, and the cumulative Poisson probabilities of 0, 1, ... STEPS - 1 for the mean of one draw."""
    draws = F.greatest(F.ceil(rate / MAX_MEAN), F.lit(1).cast("long"))
    mean = rate / draws
    step = lambda s, k: F.struct(
        (s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c")
    )
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    return F.struct(draws.cast("int").alias("draws"), F.aggregate(F.sequence(F.lit(1), F.lit(STEPS - 1)), first, step, lambda s: s["c"]).alias("steps"))


def poisson_count(laid: F.Column, seed: int, name: F.Column) -> F.Column:
    """The Poisson count of a row: for each draw the steps of the ladder at or below the draw's uniform number."""
    drawn = lambda u: F.size(F.filter(laid["steps"], lambda c: c <= u))
    first = drawn(_uniform(F.lit(str(seed)), name))
    others = F.transform(F.sequence(F.lit(2), laid["draws"]), lambda k: drawn(_uniform(F.lit(str(seed)), name, k.cast("string"))))
    return F.when(laid["draws"] > 1, F.aggregate(others, first, lambda x, y: x + y)).otherwise(first)


def mix_columns(docs: DataFrame) -> list[str]:
    """The names of mix_sources' results beside the columns of docs: source, copy, order."""
    return [free_name(c, docs.columns) for c in ("mix_source", "mix_copy", "mix_order")]


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: int = 17, broadcast_rows: int = 50_000) -> DataFrame:
    """docs with each row repeated by its count, plus mix_source, mix_copy (from 1) and mix_order (64 hexadecimal
    digits); the global order of the mixture is mix_order."""
    source, copy, order = mix_columns(docs)
    rates = source_rates(docs, weights, total).select(F.col("mix_source").alias(source), ladder(F.col("mix_rate")).alias(order))
    if rates.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rates = F.broadcast(rates)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    repeated = (
        docs.withColumn(source, F.coalesce(F.col("source"), F.lit("")))
        .join(rates, source)
        .withColumn(copy, poisson_count(F.col(order), seed, name))
        .filter(F.col(copy) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
        .withColumn(order, F.sha2(F.concat_ws("|", F.lit(str(seed)), name, F.col(copy).cast("string")), 256))
    )
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns], source, copy, order)


def shuffled(mixed: DataFrame, order: str = "mix_order") -> DataFrame:
    """The mixture range-partitioned and sorted by its order: reading partitions in order gives the global order.

    Partition k of P holds the k-th of P equal ranges of the order's first eight digits."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * parts / float(1 << 32)).cast("int")
    return mixed.repartitionById(parts, place).sortWithinPartitions(order, "doc_id")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, copy, shuffle_key of each repetition, in the mixture's global order."""
    mixed = mix_sources(docs.select("doc_id", "source"), **how)
    return shuffled(mixed).select("doc_id", F.col("mix_source").alias("source"), F.col("mix_copy").alias("copy"), F.col("mix_order").alias("shuffle_key"))


ORACLE_SQL = """
WITH n AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
     rates AS (SELECT source, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM n) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
     split AS (SELECT source, greatest(ceil(rate / 16.0), 1)::BIGINT AS draws, rate / greatest(ceil(rate / 16.0), 1) AS mean FROM rates),
     steps AS (SELECT source, k, exp(-mean) * CASE WHEN k = 0 THEN 1.0 ELSE pow(mean, k) / gamma(k + 1.0) END AS p
               FROM split, range(0, 64) AS t(k)),
     ladder AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
     drawn AS (SELECT d.doc_id, coalesce(d.source, '') AS source, j,
                      ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, '') || CASE WHEN j > 1 THEN '|' || j::VARCHAR ELSE '' END), 1, 13))::UBIGINT::DOUBLE
                      / 4503599627370496.0 AS u
               FROM documents d JOIN split s ON coalesce(d.source, '') = s.source, unnest(range(1, s.draws + 1)) AS r(j)),
     counts AS (SELECT d.doc_id, d.source, count(*) AS times
                FROM drawn d JOIN ladder l ON d.source = l.source AND l.c <= d.u GROUP BY d.doc_id, d.source)
SELECT doc_id, source, copy::INTEGER AS copy, sha256('17|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR) AS shuffle_key
FROM counts, unnest(range(1, times + 1)) AS r(copy)
"""
