"""Loan and lease schedules recalculated without row-by-row code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lease_closed_form(rows: DataFrame, by: str, k: str, payment: str, opening: str, rate: str) -> DataFrame:
    """Add balance_open, interest and balance_close for a constant rate per lease.

    The recurrence balance * (1 + n) - payment has the closed form (1+n)^k (J0 - sum of payment_i / (1+n)^i):
    one running sum. `k` counts periods from 1.
    """
    running = W.partitionBy(by).orderBy(k).rowsBetween(W.unboundedPreceding, 0)
    growth = F.power(1 + F.col(rate), F.col(k))
    close = growth * (F.col(opening) - F.sum(F.col(payment) / growth).over(running))
    return (
        rows.withColumn("balance_close", close)
        .withColumn("balance_open", (F.col("balance_close") + F.col(payment)) / (1 + F.col(rate)))
        .withColumn("interest", F.col("balance_open") * F.col(rate))
    )


def with_opening_row(body: DataFrame, rows: DataFrame, by: str, k: str, opening: str) -> DataFrame:
    """`body` and a row k = 0 for each schedule: the opening value as its closing balance, and no flow."""
    first = rows.groupBy(by).agg(F.max(opening).alias("balance_close")).withColumn(k, F.lit(0).cast("long"))
    return body.unionByName(first, allowMissingColumns=True)


def loan_running(rows: DataFrame, by: str, k: str, capital: str, opening: str, rate: str) -> DataFrame:
    """Add balance_close, balance_open and interest where capital is given: no recurrence at all."""
    running = W.partitionBy(by).orderBy(k).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("balance_close", F.col(opening) - F.sum(capital).over(running))
        .withColumn("balance_open", F.col("balance_close") + F.col(capital))
        .withColumn("interest", F.col("balance_open") * F.col(rate))
    )


#: Periods that one inner fold of a recurrence goes through.
STRETCH = 64


def recurrence(rows: DataFrame, by: str, k: str, payment: str, opening: str, rate: str) -> DataFrame:
    """(by, k, balance_open, interest, balance_close) for rates that change: one fold for each loan.

    A loan's periods are one array, so its size is that of one schedule. Balances round period by period, as a sheet's
    do, which no running product would. Appending to an array copies it, so a fold over stretches of STRETCH periods
    holds an inner one over each of them.
    """
    folded = rows.groupBy(by).agg(_periods(k, payment, rate), F.max(opening).alias("j0"))
    return _lines(folded, by)


def _periods(k: str, payment: str, rate: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), F.col(payment).alias("p"), F.col(rate).alias("n")))).alias("s")


def _lines(folded: DataFrame, *by: str) -> DataFrame:
    """The lines of each array of periods `s` that opens with `j0`, under the columns `by`."""
    line = "struct<k:bigint,balance_open:double,interest:double,balance_close:double>"
    start = lambda j, kind: F.struct(j.alias("j"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        interest = a["j"] * x["n"]
        close = a["j"] + interest - x["p"]
        row = F.struct(x["k"].cast("bigint").alias("k"), a["j"].alias("balance_open"), interest.alias("interest"), close.alias("balance_close"))
        return F.struct(close.alias("j"), F.array_append(a["out"], row).alias("out"))

    def stretch(a: Column, i: Column) -> Column:
        part = F.aggregate(F.slice("s", i * STRETCH + 1, F.lit(STRETCH)), start(a["j"], line), step)
        return F.element_at(F.transform(F.array(part), lambda p: F.struct(p["j"].alias("j"), F.array_append(a["out"], p["out"]).alias("out"))), 1)

    stretches = F.sequence(F.lit(0), F.expr(f"cast((size(s) - 1) div {STRETCH} as int)"))
    lines = F.aggregate(stretches, start(F.col("j0").cast("double"), f"array<{line}>"), stretch, lambda a: F.flatten(a["out"]))
    return folded.select(*by, F.inline(lines))


#: Periods of a block of a scanned recurrence, and blocks that one row composes.
SPAN = 1024


def recurrence_scan(rows: DataFrame, by: str, k: str, payment: str, opening: str, rate: str, span: int = SPAN) -> DataFrame:
    """What `recurrence` gives, with any one schedule spread over tasks.

    A period takes an opening balance J to (1 + n) J - p, and such maps compose. Blocks of `span` periods are composed
    into one map each, groups of `span` blocks again, and a schedule's groups are folded from its opening balance;
    then openings go down the same two steps, and each block runs period by period from its own. So one row holds
    `span` periods or blocks, or a schedule's groups: a thousand for a billion periods. `k` is a whole number that
    orders a schedule; blocks are cut by its value, so it should have few gaps. Balances differ from those of one
    long fold in the last digits only, as sums are rounded in another order.
    """
    block, group = F.floor(F.col(k) / span).alias("_block"), F.floor(F.col("_block") / span).alias("_group")
    blocks = rows.groupBy(by, block).agg(_periods(k, payment, rate), F.max(opening).alias("_j0"))
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def through(m: Column, a: Column, b: Column) -> Column:
        """First the map m, then J to a J + b."""
        return F.struct((a * m["a"]).alias("a"), (a * m["b"] + b).alias("b"))

    period = lambda m, x: through(m, 1.0 + x["n"].cast("double"), -x["p"].cast("double"))
    of_block = F.aggregate("s", one, period)
    maps = blocks.select(by, group, "_block", of_block.alias("m"), "_j0")
    part = lambda at, *more: F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "m", *more))).alias("_parts")
    grouped = maps.groupBy(by, "_group").agg(part("_block"), F.max("_j0").alias("_j0"))
    of_group = F.aggregate("_parts", one, lambda m, x: through(m, x["m"]["a"], x["m"]["b"]))
    wholes = grouped.select(by, "_group", of_group.alias("m"), "_j0").groupBy(by).agg(part("_group"), F.max("_j0").alias("_j0"))

    def openings(j: Column) -> Column:
        """(at, j): the balance that each part opens with."""
        start = F.struct(j.cast("double").alias("j"), F.expr("cast(array() as array<struct<at:bigint,j:double>>)").alias("out"))
        step = lambda a, x: F.struct(
            (x["m"]["a"] * a["j"] + x["m"]["b"]).alias("j"), F.array_append(a["out"], F.struct(x["at"].alias("at"), a["j"].alias("j"))).alias("out")
        )
        return F.inline(F.aggregate("_parts", start, step, lambda a: a["out"]))

    of_groups = wholes.select(by, openings(F.col("_j0"))).toDF(by, "_group", "_open")
    of_blocks = grouped.drop("_j0").join(of_groups, [by, "_group"]).select(by, openings(F.col("_open"))).toDF(by, "_block", "j0")
    return _lines(blocks.drop("_j0").join(of_blocks, [by, "_block"]), by)


def annex_scalars(rows: DataFrame, by: str, date: str, cutoff, year_start, next_year, balance: str, interest: str, capital: str, diff: str) -> DataFrame:
    """One row for each loan: last date up to the cut-off, the balance there, interest since the year's start,
    capital of the twelve months after the cut-off, and the largest difference.

    Balances of two rows on the last date add up, as a conditional sum by date does.
    """
    d = F.col(date)
    within = lambda a, b: (d >= F.lit(a)) & (d <= F.lit(b))
    last = F.max(F.when(d <= F.lit(cutoff), d))
    dated = rows.withColumn("_last", last.over(W.partitionBy(by)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return dated.groupBy(by).agg(
        F.max("_last").alias("last_date"),
        zero(F.sum(F.when(d == F.col("_last"), F.col(balance)))).alias("balance_at_cutoff"),
        zero(F.sum(F.when(within(year_start, cutoff), F.col(interest)))).alias("interest_to_cutoff"),
        zero(F.sum(F.when((d > F.lit(cutoff)) & (d <= F.lit(next_year)), F.col(capital)))).alias("capital_next_year"),
        F.max(F.abs(diff)).alias("max_abs_diff"),
    )
