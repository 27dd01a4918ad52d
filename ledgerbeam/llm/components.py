"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import cut, release


def _least(edges: DataFrame, found) -> DataFrame:
    """(a, m) for each node with edges, written out: joined from there, Spark can split the edges of a hub."""
    return cut(edges.groupBy("a").agg(found.alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """From links (a long, b long) to (node, root): root is the smallest node of its component.

    Only nodes with a link to another node are returned. Links may repeat, come in either order or
    join a node to itself. Each round is written to the shared folder, so lineage stays short, and deletes what
    the one before wrote.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current, before = cut(ends), None
    while True:
        seen = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == before or seen[0] == 0:
            break
        # large star: every neighbour above a node goes to the least one around it
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = _least(both, F.least(F.min("b"), F.first("a")))
        large = cut(both.join(around, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: every neighbour below a node goes to the least one of them, and so does the node
        below = _least(large, F.min("b"))
        others = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(others.union(below.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        release(current, around, large, below)
        current, before = after, seen
    ids = lambda node: current.select(F.col(node).alias("node"), F.col("b").alias("root"))
    return ids("a").union(ids("b")).distinct()
