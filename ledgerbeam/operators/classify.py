"""Current and non-current portions, and the faults of a register."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(part: Column, whole: Column) -> Column:
    """`part` brought into [0, whole]; null if either is, since least() and greatest() would skip nulls."""
    return F.when(part.isNotNull() & whole.isNotNull(), F.least(F.greatest(part, F.lit(0)), whole))


def current_portion(balance: Column, maturity: Column, scheduled: Column, booked: Column, next_year) -> Column:
    """(amount, reason): nothing owed, all due within the year, by schedule, or as booked."""
    reason = (
        F.when(balance <= 0, "no balance")
        .when(F.coalesce(maturity <= F.lit(next_year), F.lit(False)), "matures within twelve months")
        .when(scheduled.isNotNull(), "schedule")
        .otherwise("ledger")
    )
    amount = (
        F.when(balance <= 0, F.lit(0))
        .when(F.coalesce(maturity <= F.lit(next_year), F.lit(False)), balance)
        .when(scheduled.isNotNull(), clamp(scheduled, balance))
        .otherwise(clamp(booked, balance))
    )
    return F.struct(amount.alias("amount"), reason.alias("reason"))


def register_fault(balance: Column, current: Column, noncurrent: Column, tolerance=1) -> Column:
    """Why a register row is wrong; null if it isn't."""
    return (
        F.when(current < 0, "negative current portion")
        .when(noncurrent < 0, "negative non-current portion")
        .when(current > balance, "current portion over balance")
        .when(F.abs(current + noncurrent - balance) > F.lit(tolerance), "portions do not add up")
    )


def maturity(override: Column, looked_up: Column) -> Column:
    return F.coalesce(override, looked_up)
