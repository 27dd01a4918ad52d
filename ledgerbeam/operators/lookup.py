"""Lookups: first match, with a default, strict, by presence, as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rows(right: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in order. `order` should be total, or equal rows may swap."""
    others = [c for c in right.columns if c not in key]
    packed = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return right.groupBy(*key).agg(packed).select(*key, *[F.col(f"_row.{c}").alias(c) for c in others])


def last_rows(right: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in order, so later duplicates win."""
    others = [c for c in right.columns if c not in key]
    packed = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return right.groupBy(*key).agg(packed).select(*key, *[F.col(f"_row.{c}").alias(c) for c in others])


def lookup(left: DataFrame, right: DataFrame, key: list[str], order: list[str], take: list[str]) -> DataFrame:
    """Every row of `left` with the columns of its first match; null where there is none."""
    return left.join(first_rows(right.select(*dict.fromkeys([*key, *order, *take])), key, order).select(*key, *take), key, "left")


def lookup_default(left, right, key, order, take: dict[str, object]) -> DataFrame:
    """As `lookup`, with a default for each column that finds nothing, and `matched` to tell."""
    found = first_rows(right.select(*dict.fromkeys([*key, *order, *take])), key, order).select(*key, *take, F.lit(True).alias("matched"))
    joined = left.join(found, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    for name, default in take.items():
        joined = joined.withColumn(name, F.when(F.col("matched"), F.col(name)).otherwise(F.lit(default)))
    return joined


def lookup_strict(left, right, key, order, take) -> DataFrame:
    """As `lookup`, but a row without a match makes the query fail when it runs."""
    found = first_rows(right.select(*dict.fromkeys([*key, *order, *take])), key, order).select(*key, *take, F.lit(True).alias("_hit"))
    joined = left.join(found, key, "left")
    text = F.concat(F.lit("no match for "), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
    checked = F.when(F.col("_hit"), F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    return joined.where(checked).drop("_hit")


def presence(left: DataFrame, right: DataFrame, key: list[str], name: str) -> DataFrame:
    """Flag whether a key exists on the right."""
    keys = right.select(*key).distinct().withColumn(name, F.lit(True))
    return left.join(keys, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def as_of(rows: DataFrame, key: list[str], date: str, cutoff, ties: list[str]) -> DataFrame:
    """The last row of each key up to the cut-off; of equal dates the last by `ties`."""
    return last_rows(rows.where(F.col(date) <= F.lit(cutoff)), key, [date, *ties])


def normal_number(c: Column, known: Column | None = None) -> Column:
    """A number as text without leading zeros where it is all digits; exact if `known` says so."""
    bare = F.when(c.rlike("^[0-9]+$"), F.regexp_replace(c, "^0+(?=.)", "")).otherwise(c)
    return bare if known is None else F.when(known, c).otherwise(bare)
