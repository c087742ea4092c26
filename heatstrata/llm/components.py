"""Connected components of a link table, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatstrata.llm.stored import Stored


def components(links: DataFrame, store: Stored) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node that links reach.

    Each round takes the smallest label of all neighbours, and that label's own label, and stores
    the table. A node with very many links is one key of a partial aggregation only.
    """
    both = store(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = store(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = store(
            labels.join(near.join(jump, "near"), labels.node == F.col("a")).select(
                "node", F.least("label", "near", "far").alias("label"), F.col("label").alias("old")
            )
        )
        moved = new.filter("label != old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels
