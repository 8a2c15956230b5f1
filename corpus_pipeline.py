"""From documents to packed sequences: each stage reads what the one before it kept, written as Parquet.

quality   drops documents that the classifier predicts to be poor
exact     of equal texts keeps the row with the largest doc_id
near      keeps one document of each class of near copies
mix       repeats documents so that sources meet their target weights, in a global random order
pack      cuts and packs token ids into sequences of 2048
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terracell.llm.common import Written, documents, table
from terracell.llm.exact_dedup import without_copies
from terracell.llm.minhash import one_of_each_class
from terracell.llm.mixing import mix_columns, mix_sources, shuffled
from terracell.llm.packing import pack_documents
from terracell.llm.quality import good_documents
from terracell.llm.tokens import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shuffled(mix_sources(docs), mix_columns(docs)[2]).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), end=0)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: The classifier and the packing have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of sf_dir."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        kept = Written(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
