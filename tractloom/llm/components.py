"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes: one from each node to the least it is linked to, the others moved to that one.

    Members of a large group are linked to the same few least nodes; what links those is then the same for all members, and
    little more than one edge a node is left of many.
    """
    once = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = once.withColumn("least", F.min("b").over(Window.partitionBy("a")))
    return least.select(F.when(F.col("b") > F.col("least"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("least").alias("b")).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node of its component.

    Edges are thinned first, so that the rounds move about as many as there are nodes. Labels spread along edges and jump to
    the label of their label, so the rounds grow with the logarithm of the longest path. Each round is written to the shared
    folder; nothing but a count comes to the driver.
    """
    both = thinned(edges)
    both = stored(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # The label is a node itself: take that node's present label, if smaller.
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(spread.join(of_label, "label", "left").select("node", "old", F.least("label", "further").alias("label")), f"{name}-labels")
        labels = new.drop("old")
        if not new.filter("label <> old").head(1):
            return labels
