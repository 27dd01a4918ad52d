"""The engine's formulas as SQL functions of a session, for users' own queries; the optimizer inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and parameters, type of the result, and the expression.
MACROS = [
    ("effective_rate(nominal DOUBLE, periods DOUBLE)", "DOUBLE", "power(1 + try_divide(nominal, periods), periods) - 1"),
    ("compound_interest(principal DOUBLE, ea DOUBLE, days DOUBLE)", "DOUBLE", "principal * (power(1 + ea, days / 365) - 1)"),
    ("implied_principal(interest DOUBLE, ea DOUBLE, days DOUBLE)", "DOUBLE", "try_divide(interest, power(1 + ea, days / 365) - 1)"),
    ("basis_points(a DOUBLE, b DOUBLE)", "DOUBLE", "(a - b) * 10000"),
    ("verdict(diff DOUBLE, threshold DOUBLE)", "STRING", "CASE WHEN abs(diff) <= threshold THEN 'OK' ELSE 'DIFERENCIA' END"),
    ("clamp(x DOUBLE, upper DOUBLE)", "DOUBLE", "least(greatest(x, 0), upper)"),
    ("starts_with_any(account STRING, prefixes ARRAY<STRING>)", "BOOLEAN", "coalesce(exists(prefixes, p -> startswith(account, p)), false)"),
    ("obligation_kind(obligation STRING)", "STRING", "CASE WHEN contains(obligation, '-L') OR startswith(obligation, 'N/A') THEN 'lease' ELSE 'credit' END"),
]


def register(spark: SparkSession, prefix: str = "lb_") -> list[str]:
    """Create the functions in the session, each under `prefix` and its name; ones of the same name are replaced."""
    for signature, kind, body in MACROS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{signature} RETURNS {kind} RETURN {body}")
    return [prefix + signature.split("(")[0] for signature, _, _ in MACROS]
