"""Sums after each key's last mark, kept up to date as lines arrive, late ones too."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "last date, days array<date>, cents array<bigint>"


def sums_after_marks(lines: DataFrame, key: str, date: str, marks: Column, amount: Column) -> DataFrame:
    """(key, last_mark, accrued) for every key of each micro-batch: `amount` strictly after the last line that `marks` holds for.

    As `operators.criteria.max_then_sum_after`, over all lines so far in any order: a late line counts if it is dated
    after the last mark, and a late mark moves the sum only if it is the latest. A key's state is its last mark and one
    sum for each later day, so it is as long as the time since that mark. Amounts count in hundredths; lines without
    a date are left out. Write the result in update mode: the last row of a key is its present state.
    """
    cents = (F.round(amount.cast("decimal(18,2)") * 100)).cast("long")
    narrow = lines.select(F.col(key), F.col(date).cast("date").alias("day"), F.coalesce(marks, F.lit(False)).alias("mark"), F.coalesce(cents, F.lit(0)).alias("cents")).where("day is not null")
    kind = lines.schema[key].dataType.simpleString()

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, days, sums = state.get if state.exists else (None, [], [])
        by_day: dict[dt.date, int] = dict(zip(days or [], sums or []))
        for b in batches:
            found = b[b["mark"]]["day"].max() if b["mark"].any() else None
            if found is not None and (last is None or found > last):
                last = found
            for day, value in b.groupby("day")["cents"].sum().items():
                if last is None or day > last:
                    by_day[day] = by_day.get(day, 0) + int(value)
            by_day = {d: v for d, v in by_day.items() if last is None or d > last}
        state.update((last, list(by_day), list(by_day.values())))
        yield pd.DataFrame({key: [k[0]], "last_mark": pd.Series([last], dtype=object), "accrued_cents": [sum(by_day.values())]})

    out = narrow.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, last_mark date, accrued_cents long", STATE, "update", "NoTimeout")
    return out.select(key, "last_mark", (F.col("accrued_cents").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("accrued"))
