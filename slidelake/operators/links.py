"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import deleted, written


def smallest_members(links: DataFrame) -> DataFrame:
    """node, label for the nodes of links (a, b), of any type that has an order: label is the smallest node of the component.

    Each round takes the smallest label among neighbours, then that label's own label. Every round is written, so a lost
    executor costs one round at most, and the round before it is removed.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    held = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        labels = held.select("node", "label")
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = own.select(F.col("node").alias("at"), F.col("label").alias("up"))
        after = own.join(above, F.col("label") == F.col("at")).select("node", F.least("label", "up").alias("label"), (F.least("label", "up") != F.col("old")).alias("changed"))
        before, held = held, written(after, "labels")
        deleted(before)
        if held.filter("changed").isEmpty():
            deleted(edges)
            return held.select("node", "label")
