"""Rates, interest and internal rates of return as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reference_rate(rate_type: Column, rates: dict[str, float]) -> Column:
    """The index of a rate type by its leading words; the first name in `rates` is the default.

    Names compare without case. A name is matched by prefix, so `IBR 6 MESES VENCIDO` takes `IBR 6 MESES`.
    """
    (_, default), *others = rates.items()
    chosen = None
    for name, rate in sorted(others, key=lambda x: -len(x[0])):
        hit = F.upper(F.left(rate_type, F.lit(len(name)))) == name.upper()
        chosen = F.when(hit, rate) if chosen is None else chosen.when(hit, rate)
    return F.lit(default) if chosen is None else chosen.otherwise(F.lit(default))


def effective_rate(nominal: Column, periods: Column) -> Column:
    """(1 + nominal / periods) ^ periods - 1; null for no periods."""
    return F.power(1 + F.try_divide(nominal, periods), periods) - 1


def basis_points(a: Column, b: Column) -> Column:
    return (a - b) * 10000


def compound_interest(principal: Column, ea: Column, days: Column, base: int = 365) -> Column:
    return principal * (F.power(1 + ea, days / base) - 1)


def best_basis(interest: Column, on_365: Column, on_360: Column) -> Column:
    """Difference from the nearer of both day counts; a tie goes to 365."""
    a, b = on_365 - interest, on_360 - interest
    return F.when(F.abs(a) <= F.abs(b), a).otherwise(b)


def implied_rate(interest: Column, principal: Column, days: Column) -> Column:
    """The effective annual rate that gives `interest`; null without principal or days."""
    return F.power(1 + F.try_divide(interest, principal), F.try_divide(F.lit(365.0), days)) - 1


def implied_principal(interest: Column, ea: Column, days: Column) -> Column:
    return F.try_divide(interest, F.power(1 + ea, days / 365) - 1)


def period_rate_to_ea(rate: Column, unit: Column) -> Column:
    """Monthly where the unit says so, quarterly otherwise."""
    n = F.when(F.upper(unit).contains("MENS"), 12).otherwise(4)
    return F.power(1 + rate, n) - 1


def relative(a: Column, b: Column) -> Column:
    """a / b; null where b is zero or null."""
    return F.try_divide(a, b)


def present_value(flows: Column, rate: Column) -> Column:
    """Value at the first flow of equally spaced flows, by Horner's rule from the last."""
    return _value(F.reverse(flows), 1 / (1 + rate))


def _value(backwards: Column, discount: Column) -> Column:
    return F.aggregate(backwards, F.lit(0.0), lambda acc, x: acc * discount + x)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def irr(flows: Column, low: float = -0.9, high: float = 10.0, rounds: int = 80) -> Column:
    """The rate in (low, high) at which `flows`, an array of doubles, are worth nothing.

    Newton's steps on the discount factor, kept in a bracket that every step narrows: a step that leaves it is
    replaced by its middle. One fold over the flows gives value and slope; when a step moves no more, the rounds left
    do nothing. Null if the values at both ends have one sign, or there are no flows: with several roots it is one of
    them, with none it is null.
    """
    near, far = 1 / (1 + high), 1 / (1 + low)
    state = lambda a, b, d, s, done: F.struct(a.alias("a"), b.alias("b"), d.alias("d"), s.alias("s"), done.alias("done"))

    def both(f: Column, d: Column) -> Column:
        """Value and slope at a discount factor, from the last flow on."""
        start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("g"))
        return F.aggregate(f, start, lambda acc, x: F.struct((acc["v"] * d + x).alias("v"), (acc["g"] * d + acc["v"]).alias("g")))

    def solve(f: Column) -> Column:
        sign = F.signum(_value(f, F.lit(near)))
        start = state(F.lit(near), F.lit(far), F.lit(min(1.0, far)), sign, F.lit(False))

        def narrow(x: Column, at: Column) -> Column:
            same = F.signum(at["v"]) == x["s"]
            a, b = F.when(same, x["d"]).otherwise(x["a"]), F.when(same, x["b"]).otherwise(x["d"])
            newton = x["d"] - F.try_divide(at["v"], at["g"])
            to = F.when((newton > a) & (newton < b), newton).otherwise((a + b) / 2)
            return _let(to, lambda d: state(a, b, d, x["s"], F.abs(d - x["d"]) <= 1e-15 * x["d"]))

        def step(x: Column, _: Column) -> Column:
            found = _let(both(f, x["d"]), lambda at: F.when(at["v"] == 0, state(x["a"], x["b"], x["d"], x["s"], F.lit(True))).otherwise(narrow(x, at)))
            return F.when(x["done"], x).otherwise(found)

        root = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda x: 1 / x["d"] - 1)
        return F.when(sign * F.signum(_value(f, F.lit(far))) < 0, root)

    return _let(F.reverse(flows), solve)


def expected_interest(opening: Column, closing: Column, rate: Column, days: Column) -> Column:
    """Interest that the mean of two balances would bear; a missing balance is left out of the mean."""
    present = F.filter(F.array(opening, closing), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present))
    return mean * (F.power(1 + rate, days / 365) - 1)
