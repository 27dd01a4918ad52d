"""Reconciliation: verdicts, tie-outs, hierarchies, waterfalls, proofs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(difference: Column, threshold) -> Column:
    return F.when(F.abs(difference) <= F.lit(threshold), "OK").otherwise("DIFERENCIA")


def worst_verdict(threshold, *differences: Column) -> Column:
    """By the largest of several differences; null if one of them is, as greatest() would skip it."""
    missing = reduce(lambda a, b: a | b, [d.isNull() for d in differences])
    worst = F.abs(differences[0]) if len(differences) == 1 else F.greatest(*[F.abs(d) for d in differences])
    return F.when(missing, F.lit(None)).otherwise(F.when(worst <= F.lit(threshold), "OK").otherwise("DIFERENCIA"))


def balance_conclusion(ledger: Column, bank: Column, register: Column, threshold) -> Column:
    """Four ways: no bank balance, all agree, only the register is stale, or a difference."""
    near_bank = F.abs(ledger - bank) <= F.lit(threshold)
    near_register = F.coalesce(F.abs(ledger - register) <= F.lit(threshold), F.lit(False))
    return (
        F.when(bank.isNull(), "pending")
        .when(near_bank & near_register, "OK")
        .when(near_bank, "register stale")
        .otherwise("difference")
    )


def bank_balance(certificate: Column, statement: Column, credits: Column, debits: Column) -> tuple[Column, Column]:
    """(balance, evidence): certified, else estimated from the last statement, else pending."""
    estimate = statement + F.coalesce(credits, F.lit(0)) - F.coalesce(debits, F.lit(0))
    mark = F.when(certificate.isNotNull(), "[C]").when(statement.isNotNull(), "[E]").otherwise("[P]")
    return F.coalesce(certificate, estimate), mark


def roll_forward(opening: Column, debits: Column, credits: Column) -> Column:
    return opening + debits - credits


def tie_out(book: DataFrame, facts: DataFrame, key: str, threshold) -> DataFrame:
    """Each account of `book` (opening, debits, credits, closing) against the lines of the ledger.

    Lines are summed once by account; accounts without lines tie to 0.
    """
    sums = facts.groupBy(key).agg(F.sum("debit").alias("ledger_debits"), F.sum("credit").alias("ledger_credits"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        book.join(sums, key, "left")
        .withColumn("ledger_debits", zero("ledger_debits"))
        .withColumn("ledger_credits", zero("ledger_credits"))
        .withColumn("diff_debits", F.col("debits") - F.col("ledger_debits"))
        .withColumn("diff_credits", F.col("credits") - F.col("ledger_credits"))
        .withColumn("diff_closing", F.col("closing") - roll_forward(F.col("opening"), F.col("ledger_debits"), F.col("ledger_credits")))
        .withColumn("verdict", worst_verdict(threshold, F.col("diff_debits"), F.col("diff_credits"), F.col("diff_closing")))
    )


def version_diff(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Values of `a` less those of `b` for every key of either, and where a key is missing.

    A full outer join, so that keys of one version only are seen rather than passed over.
    """
    left = a.select(*key, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(True).alias("_in_a"))
    right = b.select(*key, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_b").isNull(), "only in first").when(F.col("_in_a").isNull(), "only in second").otherwise("both")
    return left.join(right, key, "full").select(
        *key,
        *[(F.coalesce(f"_a_{v}", F.lit(0)) - F.coalesce(f"_b_{v}", F.lit(0))).alias(f"diff_{v}") for v in values],
        status.alias("status"),
    )


def hierarchy_proof(nodes: DataFrame, edges: DataFrame, key: str, value: str, threshold) -> DataFrame:
    """Each parent's own value against the sum of its children's. `edges` has (parent, child)."""
    own = nodes.select(F.col(key).alias("parent"), F.col(value).alias("own"))
    kids = (
        edges.join(nodes.select(F.col(key).alias("child"), F.col(value).alias("_v")), "child")
        .groupBy("parent")
        .agg(F.sum("_v").alias("children"))
    )
    found = own.join(kids, "parent").withColumn("diff", F.col("own") - F.col("children"))
    return found.withColumn("verdict", verdict(F.col("diff"), threshold))


def waterfall(total: DataFrame, items: list[tuple[str, DataFrame]]) -> DataFrame:
    """(step, item, amount): the total difference, its explained items, the residual, and a check of the sum.

    Each argument is a DataFrame of one row with `amount`; the result has one row for each step.
    """
    rows = [total.select(F.lit(0).alias("step"), F.lit("total").alias("item"), "amount")]
    rows += [df.select(F.lit(i).alias("step"), F.lit(name).alias("item"), "amount") for i, (name, df) in enumerate(items, 1)]
    stacked = reduce(DataFrame.unionByName, rows)
    n = len(items)
    explained = F.sum(F.when(F.col("step") > 0, F.col("amount")).otherwise(0))
    whole = F.sum(F.when(F.col("step") == 0, F.col("amount")).otherwise(0))
    ends = stacked.agg(whole.alias("w"), explained.alias("e")).select(
        F.inline(F.array(
            F.struct(F.lit(n + 1).alias("step"), F.lit("residual").alias("item"), (F.col("w") - F.col("e")).alias("amount")),
            F.struct(F.lit(n + 2).alias("step"), F.lit("check").alias("item"), (F.col("e") + (F.col("w") - F.col("e")) - F.col("w")).alias("amount")),
        ))
    )
    return stacked.unionByName(ends)


def control_total(rows: DataFrame, control: DataFrame, values: list[str], threshold) -> DataFrame:
    """(measure, reported, summed, diff, verdict): a report's own grand total against the sum of its lines."""
    sums = rows.agg(*[F.sum(v).alias(f"s_{v}") for v in values])
    both = sums.crossJoin(control.select(*[F.col(v).alias(f"r_{v}") for v in values]))  # one row each
    long = both.select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("measure"), F.col(f"r_{v}").alias("reported"), F.coalesce(f"s_{v}", F.lit(0)).alias("summed"))
        for v in values
    ])))
    return long.withColumn("diff", F.col("reported") - F.col("summed")).withColumn("verdict", verdict(F.col("diff"), threshold))


def dr_cr_proof(entries: DataFrame, by: str) -> DataFrame:
    """Debits against credits of each entry."""
    sums = entries.groupBy(by).agg(
        F.coalesce(F.sum("debit"), F.lit(0)).alias("debits"), F.coalesce(F.sum("credit"), F.lit(0)).alias("credits")
    )
    return sums.withColumn("balanced", F.col("debits") == F.col("credits"))
