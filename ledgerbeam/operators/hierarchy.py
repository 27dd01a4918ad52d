"""Trees of any depth: totals of whole subtrees, depths, cycles and orphans, in as many rounds as the depth has bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbeam.sources.scratch import cut


def roll_up(nodes: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """(node, total, depth, state) for each node of `nodes` (key, value); `edges` has (parent, child).

    Pointers are doubled: after each round a node knows its ancestor twice as far up and has the sum of all nodes
    below it up to that distance, so a chain of a million nodes takes twenty rounds. Rounds are checkpointed.
    States: "ok"; "orphan", a root whose parent is no node; "several parents", of which the least counts; "cycle",
    a node on one, and "below cycle", whose depths are null. A cycle has no totals; of nodes hanging from it the total
    is that of their own subtree. Null values count as 0. Keys are to be unique and not null.
    """
    parents = edges.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("up"), F.countDistinct("parent").alias("_n"))
    own = nodes.select(F.col(key).alias("node"), F.coalesce(F.col(value), F.lit(0)).alias("_v"))
    total = own.agg(F.sum("_v").alias("t")).schema["t"].dataType
    held = own.select(F.col("node").alias("up"), F.lit(True).alias("_held"))
    start = own.join(parents, "node", "left").join(held, "up", "left")
    state = F.when(F.col("up").isNotNull() & F.col("_held").isNull(), "orphan").when(F.col("_n") > 1, "several parents").otherwise("ok")
    known = F.when(F.col("_held"), F.col("up"))
    at = cut(start.select("node", known.alias("far"), F.col("_v").cast(total).alias("sum"), F.when(known.isNotNull(), 1).otherwise(0).cast("long").alias("depth"), state.alias("state")))
    n, reach = at.count(), 1
    while reach <= n and not at.where("far is not null").isEmpty():
        below = at.where("far is not null").groupBy(F.col("far").alias("node")).agg(F.sum("sum").alias("more"))
        above = at.select(F.col("node").alias("far"), F.col("far").alias("next"), F.col("depth").alias("rise"))
        jumped = at.join(below, "node", "left").join(above, "far", "left")
        at = cut(jumped.select("node", F.col("next").alias("far"), (F.col("sum") + F.coalesce("more", F.lit(0))).cast(total).alias("sum"), (F.col("depth") + F.coalesce("rise", F.lit(0))).alias("depth"), "state"))
        reach *= 2
    turning = at.where("far is not null").select(F.col("far").alias("node"), F.lit(True).alias("_on")).distinct()
    found = at.join(turning, "node", "left")
    on, stuck = F.col("_on").isNotNull(), F.col("far").isNotNull()
    return found.select(
        "node", F.when(~on, F.col("sum")).alias("total"), F.when(~stuck, F.col("depth")).alias("depth"),
        F.when(on, "cycle").when(stuck, "below cycle").otherwise(F.col("state")).alias("state"),
    )
