"""Ordered rules: the first that matches decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rules that a table may hold; they are read to the driver to build one expression.
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """Give `result` if every condition holds. A condition is (column, kind, operand).

    Kinds: regex, contains, startswith, endswith, equals.
    """

    result: str
    conditions: tuple[tuple[str, str, str], ...]

    def holds(self) -> Column:
        held = F.lit(True)
        for name, kind, operand in self.conditions:
            c = F.col(name)
            one = {
                "regex": lambda: c.rlike(operand),  # noqa: B023
                "contains": lambda: c.contains(operand),  # noqa: B023
                "startswith": lambda: c.startswith(operand),  # noqa: B023
                "endswith": lambda: c.endswith(operand),  # noqa: B023
                "equals": lambda: c == operand,  # noqa: B023
            }[kind]()
            held = held & F.coalesce(one, F.lit(False))
        return held


def classify(rules: list[Rule], default: str) -> Column:
    """One CASE expression over all rules in order: no join, and one pass in generated code."""
    chain = None
    for rule in rules:
        chain = F.when(rule.holds(), rule.result) if chain is None else chain.when(rule.holds(), rule.result)
    return F.lit(default) if chain is None else chain.otherwise(default)


def rules_from_table(table: DataFrame, column: str) -> list[Rule]:
    """Rules from rows (priority, kind, pattern, result) on one column; the table's size is checked."""
    rows = table.orderBy("priority", "pattern", "result").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    return [Rule(r["result"], ((column, r["kind"], r["pattern"]),)) for r in rows]


def movement_type(account: Column, debit: Column, credit: Column, obligation: Column, small=1000) -> Column:
    """What a ledger line does to its obligation, by account, sides and size."""
    d, c = F.coalesce(debit, F.lit(0)), F.coalesce(credit, F.lit(0))
    accrual = F.when(c > 0, "accrual").when(d < small, "rounding").otherwise("reversal")
    return (
        F.when(obligation.startswith("N/A"), "reclassification")
        .when(obligation == "TC", "card")
        .when(account.startswith("2130"), accrual)
        .when((c > 0) & (d > 0), "renewal")
        .when(c > 0, "drawdown")
        .otherwise("principal payment")
    )


def obligation_kind(obligation: Column) -> Column:
    """Lease or credit by the marks in an obligation's id."""
    return F.when(obligation.contains("-L") | obligation.startswith("N/A"), "lease").otherwise("credit")


#: Fixed value: how notes write the last four digits of an obligation's number.
LAST_FOUR = r"(?:CRED|LEAS)[- ]?(\d{4})"


def opening_id(note: Column, account: Column, by_last4: dict[str, str], rules: list[Rule], src_row: Column, overrides: dict[int, str], card_prefix: str = "2195", interest_prefix: str = "2130", last_four: str = LAST_FOUR) -> Column:
    """Obligation of an opening line: card, then the last four digits in interest notes, rules, row overrides.

    An interest line is settled by its digits alone: without a known number it stays unresolved.
    """
    digits = F.regexp_extract(note, last_four, 1)
    known = F.create_map(*[F.lit(x) for pair in by_last4.items() for x in pair]) if by_last4 else None
    by_digits = F.coalesce(F.try_element_at(known, digits), F.lit("SIN-ID")) if by_last4 else F.lit("SIN-ID")
    at_row = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]) if overrides else None
    by_rule = classify(rules, "SIN-ID")
    if at_row is not None:
        by_rule = F.when(by_rule == "SIN-ID", F.coalesce(F.try_element_at(at_row, src_row), F.lit("SIN-ID"))).otherwise(by_rule)
    return F.when(account.startswith(card_prefix), "TC").when(account.startswith(interest_prefix), by_digits).otherwise(by_rule)
