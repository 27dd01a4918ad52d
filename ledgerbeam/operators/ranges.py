"""Sums of a key's facts between bounds that each row of a spine brings along, by one sweep over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_month(at: Column) -> Column:
    """Blocks of a sweep over dates."""
    return F.trunc(at, "month")


def by_span(span: int) -> Callable[[Column], Column]:
    """Blocks of a sweep over numbers."""
    return lambda at: F.floor(at / span)


def sums_between(
    spine: DataFrame, facts: DataFrame, on: list[str], at: str, low: str, high: str, amount: str, name: str,
    block: Callable[[Column], Column] = by_month, with_low: bool = True, with_high: bool = True,
) -> DataFrame:
    """`spine` with `name`: `amount` of the facts of its key with `low` <= `at` <= `high`, 0 where there are none.

    A key may have any number of bounds. Facts are summed by key and `at`; both bounds of all spine rows join them as
    events, and one running sum gives what lies before each: the difference of two is the answer, so nothing is
    compared row by row. Running sums stay inside (key, block of `at`), and each block carries what lies before it,
    so a key with very many facts or bounds is spread over tasks; `block` has to grow with `at`. Null bounds are
    open; bounds the wrong way round, and null keys, give 0; facts without `at` never count. `with_low` and
    `with_high` tell whether the bounds themselves belong. Use decimals: differences of doubles leave traces.
    """
    key = [F.col(c) for c in on]
    before, upto = F.lit(0), F.lit(2)  # facts of the same `at` come between
    daily = facts.where(F.col(at).isNotNull()).groupBy(*key, F.col(at).alias("_at")).agg(F.sum(amount).alias("_v"))
    bound = lambda c, side: spine.select(*key, F.col(c).alias("_at"), side.alias("_side"))
    lows, highs = (before if with_low else upto), (upto if with_high else before)
    probes = bound(low, lows).where("_at is not null").union(bound(high, highs)).distinct()
    none = F.lit(0).cast(daily.schema["_v"].dataType).alias("_v")
    events = daily.select(*on, "_at", F.lit(1).alias("_side"), "_v").union(probes.select(*on, "_at", "_side", none))
    events = events.withColumn("_block", block(F.col("_at")))
    inside = W.partitionBy(*on, "_block").orderBy(F.asc_nulls_last("_at"), "_side").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*on).orderBy(F.asc_nulls_last("_block")).rowsBetween(W.unboundedPreceding, -1)
    swept = events.withColumn("_sum", F.sum("_v").over(inside))
    totals = events.groupBy(*on, "_block").agg(F.sum("_v").alias("_total"))
    carried = totals.select(*[F.col(c).alias(f"_k_{c}") for c in on], F.col("_block").alias("_b"), F.sum("_total").over(earlier).alias("_carry"))
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(f"_k_{c}"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    looked = swept.where("_side <> 1").join(carried, same & F.col("_block").eqNullSafe(F.col("_b")))
    looked = looked.select(*on, "_at", "_side", (zero("_sum") + zero("_carry")).alias("_upto"))
    out = spine
    for end, c, side in (("_l", low, lows), ("_h", high, highs)):
        found = looked.where(F.col("_side") == side).select(*[F.col(k).alias(f"{end}_{k}") for k in on], F.col("_at").alias(f"{end}_at"), F.col("_upto").alias(end))
        match = F.col(c) == F.col(f"{end}_at") if end == "_l" else F.col(c).eqNullSafe(F.col(f"{end}_at"))  # an open low end has nothing before it
        for k in on:
            match = match & (F.col(k) == F.col(f"{end}_{k}"))
        out = out.join(found, match, "left").drop(f"{end}_at", *[f"{end}_{k}" for k in on])
    turned = F.coalesce(F.col(low) > F.col(high), F.lit(False))
    value = F.when(turned, F.lit(0)).otherwise(zero("_h") - zero("_l"))
    if not with_low or not with_high:
        value = F.when(F.col(low) == F.col(high), F.lit(0)).otherwise(value)
    return out.withColumn(name, value.cast(daily.schema["_v"].dataType)).drop("_l", "_h")
