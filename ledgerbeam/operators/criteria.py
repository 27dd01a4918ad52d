"""Spreadsheet criteria as predicates, and conditional aggregates attached to a spine of keys.

Text compares without case; `*` and `?` are wildcards; `<>x` also holds for blanks; nothing found sums to 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FORM = re.compile(r"(<>|<=|>=|=|<|>)?(.*)", re.S)
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def criterion(c: Column, text: str | int | float, numeric: bool = False) -> Column:
    """The predicate of one criterion on column `c`; never null.

    `"<>"` asks for values that are there, `""` and `"="` for blanks. A number matches numbers and texts that
    read as that number. Comparisons with `<` and the like hold for numbers, and between texts where the
    operand is no number. With `numeric` the column is known to hold numbers: comparisons are then plain ones,
    which scans can take over.
    """
    sign, operand = _FORM.fullmatch(str(text)).groups()
    if operand == "":
        blank = c.isNull() if numeric else F.coalesce(c.cast("string"), F.lit("")) == ""
        return ~blank if sign == "<>" else blank
    if _NUMBER.fullmatch(operand):
        number = c if numeric else c.cast("string").try_cast("double")
        value = F.lit(int(operand) if re.fullmatch(r"[+-]?[0-9]{1,18}", operand) else float(operand))
        held = {"<": number < value, ">": number > value, "<=": number <= value, ">=": number >= value}.get(sign, number == value)
        if numeric and sign != "<>":
            return held & c.isNotNull()
    else:
        word = F.upper(c.cast("string"))
        if sign in ("<", ">", "<=", ">="):
            value = F.lit(operand.upper())
            held = {"<": word < value, ">": word > value, "<=": word <= value, ">=": word >= value}[sign]
        else:
            held = _like(word, operand.upper())
    held = F.coalesce(held, F.lit(False))
    return ~held if sign == "<>" else held


def _like(word: Column, pattern: str) -> Column:
    if not re.search(r"[*?]", pattern):
        return word == pattern
    body = pattern.strip("*")
    if not re.search(r"[*?~]", body):  # the plain forms need no pattern; on upper(...) they run after the scan
        if pattern == body + "*":
            return word.startswith(body)
        if pattern == "*" + body:
            return word.endswith(body)
        if pattern == f"*{body}*":
            return word.contains(body)
    parts = re.split(r"(~[*?~]|[*?])", pattern)
    wild = {"*": r"(?s:.*)", "?": r"(?s:.)"}
    return word.rlike("^" + "".join(wild.get(p) or re.escape(p[1:] if re.fullmatch(r"~[*?~]", p) else p) for p in parts) + "$")


def all_of(criteria: dict[str, str | int | float | list], schema: T.StructType | None = None) -> Column:
    """All criteria hold: column name to criterion, or to a list of them. `schema` tells which columns are numbers."""
    numbers = {f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)} if schema else set()
    held = F.lit(True)
    for name, wanted in criteria.items():
        for one in wanted if isinstance(wanted, list) else [wanted]:
            held = held & criterion(F.col(name), one, name in numbers)
    return held


def sum_if(value: str, condition: Column) -> Column:
    """Aggregate: sum where the condition holds, 0 if nothing does."""
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))


#: How an aggregate that adds up begins when it is shown.
_ADDS_UP = re.compile(r"Column<'(coalesce\()?(sum|count|count_if)\(")


def attach(spine: DataFrame, facts: DataFrame, on: list[str], **aggregates: Column) -> DataFrame:
    """`spine` with aggregates of `facts` by key: one aggregation and one left join for all of them.

    Counts and sums of keys without facts are 0; others, such as maxima and means, stay null.
    """
    summed = facts.groupBy(*on).agg(*[a.alias(name) for name, a in aggregates.items()])
    joined = spine.join(summed, on, "left")
    kinds = dict(summed.dtypes)
    numbers = {n for n, a in aggregates.items() if _ADDS_UP.match(str(a))}
    return joined.select(
        *[F.coalesce(c, F.lit(0)).cast(kinds[c]).alias(c) if c in numbers else F.col(c) for c in joined.columns]
    )


def sumifs(spine: DataFrame, facts: DataFrame, on: list[str], value: str, name: str, **criteria) -> DataFrame:
    """Conditional sum for each key of the spine; the condition filters before the shuffle."""
    return attach(spine, facts.where(all_of(criteria, facts.schema)), on, **{name: F.sum(value)})


def countifs(spine: DataFrame, facts: DataFrame, on: list[str], name: str, **criteria) -> DataFrame:
    return attach(spine, facts.where(all_of(criteria, facts.schema)), on, **{name: F.count(F.lit(1))})


def maxifs(spine: DataFrame, facts: DataFrame, on: list[str], value: str, name: str, default, **criteria) -> DataFrame:
    """Conditional maximum; `default` where nothing matches, as a spreadsheet's 0."""
    found = facts.where(all_of(criteria, facts.schema)).groupBy(*on).agg(F.max(value).alias(name))
    return spine.join(found, on, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def max_then_sum_after(
    spine: DataFrame, facts: DataFrame, on: list[str], date: str, marks: Column, amount: Column, name: str, last: str
) -> DataFrame:
    """`amount` summed strictly after each key's last row that `marks` holds for; all of it where none does.

    The facts are read once and summed by key and date before anything else, so a key with very many rows is short.
    """
    daily = facts.groupBy(*on, date).agg(F.max(F.coalesce(marks, F.lit(False))).alias("_mark"), F.sum(amount).alias("_sum"))
    latest = F.max(F.when(F.col("_mark"), F.col(date))).over(W.partitionBy(*on))
    after = F.col(last).isNull() | (F.col(date) > F.col(last))
    sums = daily.withColumn(last, latest).groupBy(*on).agg(F.max(last).alias(last), F.sum(F.when(after, F.col("_sum"))).alias(name))
    found = spine.join(sums, on, "left")
    return found.withColumn(name, F.coalesce(name, F.lit(0)).cast(sums.schema[name].dataType))
