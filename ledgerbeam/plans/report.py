"""Reports: stacked tables with provenance, dashboards, narratives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stack(blocks: list[tuple[str, DataFrame, list[str]]], gap: int = 2) -> DataFrame:
    """Blocks (title, rows, order) in one table: block, title, src_row, row_no and all columns of any block.

    Each block has a title line before its rows and `gap` empty ones after. row_no is the row in the stack;
    src_row the row in the block. Blocks are reports, so each is numbered in one window.
    """
    parts, sizes = [], []
    for i, (title, rows, order) in enumerate(blocks):
        numbered = rows.withColumn("src_row", F.row_number().over(W.orderBy(*order)))
        parts.append(numbered.withColumn("block", F.lit(i)).withColumn("title", F.lit(title)))
        sizes.append(rows.agg(F.lit(i).alias("block"), F.count(F.lit(1)).alias("n")))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = reduce(DataFrame.unionByName, sizes).select("block", F.coalesce(F.sum(F.col("n") + 1 + gap).over(before), F.lit(0)).alias("_off"))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.join(F.broadcast(offsets), "block").withColumn("row_no", F.col("_off") + 1 + F.col("src_row")).drop("_off")  # a row for each block


def dashboard(tests: list[tuple[str, DataFrame, object]]) -> DataFrame:
    """(no, test, value, verdict) from tests (name, one row with `value`, threshold)."""
    rows = [
        df.select(F.lit(i).alias("no"), F.lit(name).alias("test"), F.col("value").cast("double").alias("value"), F.lit(float(limit)).alias("_limit"))
        for i, (name, df, limit) in enumerate(tests, 1)
    ]
    stacked = reduce(DataFrame.unionByName, rows)
    verdict = F.when(F.col("value").isNull(), "pending").when(F.abs("value") <= F.col("_limit"), "OK").otherwise("DIFERENCIA")
    return stacked.withColumn("verdict", verdict).drop("_limit")
