"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guichet.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links(a, b)`; the component is its smallest node.

    Each round points every node to its smallest neighbour, follows the pointers to local minima, and contracts the
    links to those; the number of links falls at least by half in each round. Only aggregates and joins on the node
    are used, so a hub is split like any skewed join. Nodes without links have no row. Self links count as no link.
    """
    links = staged(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    label = nodes.select("node", F.col("node").alias("component"))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        point = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        point = staged(point, "pointers")
        for _ in range(2):  # two jumps: chains of four collapse in one round
            after = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            point = point.join(after, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        point = staged(point, "pointers")
        label = label.join(point.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        label = staged(label, "labels")
        links = links.join(point.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(point.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        links = staged(links.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    return label
