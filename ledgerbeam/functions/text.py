"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how ledgers write interest in a line's free text. The letters SE have to follow the second E; at least two digits.
GLOSS = r"INTE?RE?SES?\s*[:$]?\s*([\d][\d\.,]*\d)"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; null gives an empty text."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def gloss_text(c: Column) -> Column:
    """The number as it is written, null where there is none."""
    found = F.regexp_extract(c, GLOSS, 1)
    return F.when(found != "", found)


def gloss_amount(c: Column) -> Column:
    """The amount in a line's free text: dots part thousands, but for a last group of one or two digits.

    The number is split at its dots, and the lengths of its groups tell how to read it: one group is whole, several
    are up to three digits and then threes, the last of three or more of them also a fraction of one or two digits.
    """
    groups = F.split(gloss_text(c), r"\.")
    n, length = F.size(groups), F.transform(groups, F.length)
    last = F.element_at(length, -1)
    plain = F.forall(groups, lambda g: g.rlike("^[0-9]+$"))
    threes = (F.element_at(length, 1) <= 3) & F.forall(F.slice(length, 2, F.greatest(n - 2, F.lit(0))), lambda x: x == 3)
    whole = (n == 1) | (threes & (last == 3))
    fraction = (n > 2) & threes & (last <= 2)
    joined = F.array_join(groups, "")
    cents = F.concat(F.array_join(F.slice(groups, 1, n - 1), ""), F.lit("."), F.element_at(groups, -1))
    return F.when(plain & whole, joined.try_cast("double")).when(plain & fraction, cents.try_cast("double"))


def gloss_status(c: Column) -> Column:
    """Parsed, unreadable (a number that no rule reads) or absent."""
    return F.when(gloss_amount(c).isNotNull(), "parsed").when(gloss_text(c).isNotNull(), "unreadable").otherwise("absent")


def amount_text(c: Column, sign: str = "") -> Column:
    """A whole number with commas: rounded half up first, since format_number rounds half to even."""
    return F.concat(F.lit(sign), F.format_number(F.round(c, 0), 0))


def percent_text(c: Column) -> Column:
    return F.concat(F.format_number(F.round(c * 100, 0), 0), F.lit("%"))


def replace_labels(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replacements in order, each on what the one before left."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def label(number: Column, description: Column) -> Column:
    """`number – description`, or whichever is there."""
    return F.concat_ws(" – ", number, description)
