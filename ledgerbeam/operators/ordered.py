"""Operators over ordered rows: forward fill, lag with a default, bodies of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def forward_fill(rows: DataFrame, order: str, value: str, name: str, span: int = 100_000) -> DataFrame:
    """Add `name`: the last non-null `value` up to each row of one long sequence of numbers `order`.

    Blocks of `span` numbers are filled on their own; a summary of one row for each block carries values over
    block edges. So no task sorts the whole sequence.
    """
    blocks = rows.withColumn("_block", F.floor(F.col(order) / span).cast("long"))
    inside = W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    last = blocks.groupBy("_block").agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    carried = last.select("_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    filled = blocks.withColumn("_own", F.last(value, ignorenulls=True).over(inside)).join(carried, "_block")
    return filled.withColumn(name, F.coalesce("_own", "_carried")).drop("_block", "_own", "_carried")


def lag_default(value: Column, default: Column, by: list[str], order: list[str]) -> Column:
    """The value of the row before; `default` in the first row, and where that value is null."""
    return F.coalesce(F.lag(value).over(W.partitionBy(*by).orderBy(*order)), default)


def take_body(rows: DataFrame, by: list[str], order: str, valid: Column, skip_leading: bool) -> DataFrame:
    """The rows of a table's body: up to the first invalid one, after leading invalid ones if these are skipped."""
    marked = rows.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    first = F.min(F.when(F.col("_ok"), F.col(order))) if skip_leading else F.min(order)
    starts = marked.groupBy(*by).agg(first.alias("_start"))
    from_start = marked.join(starts, by).where(F.col(order) >= F.col("_start"))
    ends = from_start.groupBy(*by).agg(F.min(F.when(~F.col("_ok"), F.col(order))).alias("_end"))
    body = from_start.join(ends, by).where(F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    return body.drop("_ok", "_start", "_end")


def share_of_group(value: str, by: list[str]) -> Column:
    """Part of the group's total; null where the total is 0."""
    return F.try_divide(F.col(value).cast("double"), F.sum(value).over(W.partitionBy(*by)).cast("double"))
