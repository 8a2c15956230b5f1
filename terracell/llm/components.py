"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def components(links: DataFrame) -> Written:
    """(node, label) for each node of links (a, b); label is the smallest node of its component.

    Every round takes the smallest label among neighbours and then follows the label's own label, so that long chains
    halve.  Minima are pre-aggregated before each shuffle; labels are written to the shared folder between rounds, and
    only the number of changed labels reaches the driver.
    """
    both = Written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = Written(both.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.df.join(labels.df.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        one = labels.df.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        to = labels.df.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = Written(one.join(to, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = new.df.filter("label < old").count()
        labels.drop()
        labels, new.df = new, new.df.select("node", "label")
        if not changed:
            both.drop()
            return labels
