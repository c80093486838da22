"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.llm.common import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node it is connected to. Nodes are of an ordered type.

    Each round takes the smallest label among the neighbours and then the label of that label, so paths halve. Rounds are
    written tables. A node with very many neighbours takes part in joins (which adaptive execution may split) and in minima
    with partial aggregation, never as a list.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = stored(both.union(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = stored(both.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("before"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        last, labels = labels, stored(lower.join(jump, "low", "left").select("node", F.least("low", "further").alias("label"), "before"))
        dropped(last)
        if not labels.where("label <> before").limit(1).count():
            dropped(both)
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("before")
