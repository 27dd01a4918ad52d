"""The main workpaper: assertions, procedures and conclusions that follow from figures, and proofs across tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerbeam.functions import macros
from ledgerbeam.operators import recon, versions
from ledgerbeam.plans.audit_queries import _OVERVIEW, _overview
from ledgerbeam.plans.tables import LEDGER, MONEY, REGISTER, ledger, read, register

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _whole(x: str) -> str:
    return f"CAST(CAST(round({x}) AS BIGINT) AS STRING)"


#: Assertion, procedure, result as text over the values of `_overview`, what is an exception, and what leaves it open.
ASSERTIONS = [
    ("1 Existence", "Trace every balance of the register to entries of the ledger", f"'without entries: ' || {_whole('uncovered')} || ' of ' || {_whole('n')}", "uncovered > 0", "n = 0"),
    ("2 Completeness", "Compare the total of the ledger with its two sides", f"'total less sides: ' || {_whole('lines - debits - credits')} || '; entries: ' || {_whole('n_lines')}", "abs(lines - debits - credits) > 1000", "n_lines = 0"),
    ("3 Accuracy", "Add up both portions of every balance", f"'portions less balances: ' || {_whole('portions')} || '; faulty rows: ' || {_whole('faulty')}", "abs(portions) > 1000 OR faulty > 0", "n = 0"),
    ("4 Cut-off", "Look for terms that end before they start and for entries without amount", f"'turned round: ' || {_whole('backwards')} || '; empty: ' || {_whole('empty')}", "backwards > 0 OR empty > 0", "n = 0 OR n_lines = 0"),
    ("5 Valuation", "Compare credits with what has been accrued", f"'not accrued: ' || {_whole('credits - accrued')}", "abs(credits - accrued) > 1000", "credits = 0"),
    ("6 Classification", "Recalculate the current portion of every balance", f"'current: ' || {_whole('current')} || ' of ' || {_whole('principal')}", "current > principal OR negative > 0", "principal = 0"),
    ("7 Concentration", "Hold the largest balance against the limit", f"'largest: ' || {_whole('largest')}", "largest > 1000000", "largest IS NULL"),
]
_CONCLUSION = "CASE WHEN coalesce({open}, true) THEN 'pending' WHEN {exception} THEN 'exception' ELSE 'satisfied' END"


@query(_OVERVIEW + " SELECT no_::INT AS no, assertion, procedure, result, conclusion FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS no_, '{a}' AS assertion, '{p}' AS procedure, {r} AS result, {_CONCLUSION.format(open=o, exception=e)} AS conclusion FROM w" for i, (a, p, r, e, o) in enumerate(ASSERTIONS, 1)) + ")")
def workpaper_assertions(spark, d):
    """Each assertion with its procedure, the figures found, and the conclusion that they allow."""
    return _assertions(spark, d)


def _assertions(spark, d):
    line = lambda i, a, p, r, e, o: F.struct(
        F.lit(i).alias("no"), F.lit(a).alias("assertion"), F.lit(p).alias("procedure"), F.expr(r).alias("result"), F.expr(_CONCLUSION.format(open=o, exception=e)).alias("conclusion")
    )
    return _overview(spark, d).select(F.inline(F.array(*[line(i, *x) for i, x in enumerate(ASSERTIONS, 1)])))


_OPINION = "CASE WHEN n_exceptions = 0 AND n_pending = 0 THEN 'fairly stated' WHEN n_exceptions = 0 THEN 'fairly stated, subject to what is pending' WHEN n_exceptions <= 2 THEN 'fairly stated, except for the assertions named' ELSE 'adjustments needed' END"


@query(_OVERVIEW + ", a AS (" + " UNION ALL ".join(f"SELECT '{a}' AS assertion, {_CONCLUSION.format(open=o, exception=e)} AS c FROM w" for a, _, _, e, o in ASSERTIONS) + f"""),
  s AS (SELECT count(*) AS n_assertions, count(*) FILTER (c = 'exception') AS n_exceptions, count(*) FILTER (c = 'pending') AS n_pending, coalesce(string_agg(assertion, '; ' ORDER BY assertion) FILTER (c <> 'satisfied'), '') AS named FROM a)
  SELECT n_assertions::BIGINT AS n_assertions, n_exceptions::BIGINT AS n_exceptions, n_pending::BIGINT AS n_pending, named, {_OPINION} AS opinion FROM s""")
def workpaper_conclusion(spark, d):
    """The opinion that follows from the assertions, with those that stand in its way."""
    is_ = lambda c: F.count_if(F.col("conclusion") == c)
    named = F.array_join(F.array_sort(F.collect_list(F.when(F.col("conclusion") != "satisfied", F.col("assertion")))), "; ")
    found = _assertions(spark, d).agg(F.count(F.lit(1)).alias("n_assertions"), is_("exception").alias("n_exceptions"), is_("pending").alias("n_pending"), named.alias("named"))
    return found.withColumn("opinion", F.expr(_OPINION))


#: Proofs whose sides come from different tables: name, left, right.
CROSS = [
    ("register = ledger, amounts", "r_balance", "l_amount"), ("register = ledger, obligations", "r_n", "l_obligations"), ("customers of the register = all customers", "r_customers", "c_n"),
    ("suppliers of the ledger = all suppliers", "l_suppliers", "s_n"), ("parts of the ledger = all parts", "l_parts", "p_n"), ("last start <= last entry, days", "r_last", "l_last"),
]


@query(f"""WITH {LEDGER}, {REGISTER}, l AS (SELECT sum(amount)::DOUBLE AS l_amount, count(DISTINCT obligation_id)::DOUBLE AS l_obligations, count(DISTINCT l_suppkey)::DOUBLE AS l_suppliers, count(DISTINCT l_partkey)::DOUBLE AS l_parts, (max(entry_date) - DATE '1970-01-01')::DOUBLE AS l_last FROM ledger),
  r AS (SELECT sum(balance)::DOUBLE AS r_balance, count(*)::DOUBLE AS r_n, count(DISTINCT custkey)::DOUBLE AS r_customers, (max(start) - DATE '1970-01-01')::DOUBLE AS r_last FROM register),
  w AS (SELECT * FROM l, r, (SELECT count(*)::DOUBLE AS c_n FROM customer), (SELECT count(*)::DOUBLE AS s_n FROM supplier), (SELECT count(*)::DOUBLE AS p_n FROM part))
  SELECT no_::INT AS no, proof, x AS left_side, y AS right_side, round(x - y, 2) AS diff, CASE WHEN abs(x - y) <= 0.5 THEN 'OK' ELSE 'DIFERENCIA' END AS verdict FROM (""" + " UNION ALL ".join(f"SELECT {i} AS no_, '{p}' AS proof, {x} AS x, {y} AS y FROM w" for i, (p, x, y) in enumerate(CROSS, 1)) + ")")
def cross_proofs(spark, d):
    """Proofs that can fail: each side is summed from a table of its own, once for each table."""
    total = lambda c: F.sum(c).cast("double")
    distinct = lambda c: F.countDistinct(c).cast("double")
    days = lambda c: F.unix_date(F.max(c)).cast("double")
    one = ledger(spark, d).agg(total("amount").alias("l_amount"), distinct("obligation_id").alias("l_obligations"), distinct("l_suppkey").alias("l_suppliers"), distinct("l_partkey").alias("l_parts"), days("entry_date").alias("l_last"))
    one = one.crossJoin(register(spark, d).agg(total("balance").alias("r_balance"), F.count(F.lit(1)).cast("double").alias("r_n"), distinct("custkey").alias("r_customers"), days("start").alias("r_last")))  # one row each
    for name, n in (("customer", "c_n"), ("supplier", "s_n"), ("part", "p_n")):
        one = one.crossJoin(read(spark, d, name).agg(F.count(F.lit(1)).cast("double").alias(n)))
    line = lambda i, p, x, y: F.struct(F.lit(i).alias("no"), F.lit(p).alias("proof"), F.col(x).alias("left_side"), F.col(y).alias("right_side"))
    rows = one.select(F.inline(F.array(*[line(i, *p) for i, p in enumerate(CROSS, 1)])))
    diff = F.col("left_side") - F.col("right_side")
    return rows.select("no", "proof", "left_side", "right_side", F.round(diff, 2).alias("diff"), recon.verdict(diff, 0.5).alias("verdict"))


@query(f"""WITH {LEDGER}, a AS (SELECT obligation_id, sum(debit) AS dr, sum(credit) AS cr FROM ledger GROUP BY 1),
  b AS (SELECT obligation_id, CASE WHEN obligation_id % 1000 = 7 THEN dr + 5 ELSE dr END AS dr, cr FROM a WHERE obligation_id % 997 <> 3)
  SELECT a.obligation_id, (a.dr - coalesce(b.dr, 0))::DOUBLE AS diff_dr, (a.cr - coalesce(b.cr, 0))::DOUBLE AS diff_cr, CASE WHEN b.obligation_id IS NULL THEN 'only in first' ELSE 'both' END AS status
  FROM a LEFT JOIN b USING (obligation_id) WHERE b.obligation_id IS NULL OR a.dr <> b.dr OR a.cr <> b.cr""")
def version_changes(spark, d):
    """Rows in which two versions of the balances differ: digests of buckets say where to look."""
    key = F.col("obligation_id")
    first = ledger(spark, d).groupBy("obligation_id").agg(F.sum("debit").cast(MONEY).alias("dr"), F.sum("credit").cast(MONEY).alias("cr"))
    second = first.where(key % 997 != 3).withColumn("dr", F.when(key % 1000 == 7, F.col("dr") + 5).otherwise(F.col("dr")).cast(MONEY))
    found = versions.changes(first, second, ["obligation_id"], ["dr", "cr"])
    return found.select("obligation_id", F.col("diff_dr").cast("double").alias("diff_dr"), F.col("diff_cr").cast("double").alias("diff_cr"), "status")


@query(f"""WITH {REGISTER} SELECT obligation_id, round(power(1 + spread / periods, periods) - 1, 8) AS ea, round(balance::DOUBLE * (power(1 + power(1 + spread / periods, periods) - 1, 30.0 / 365) - 1), 4) AS month_interest,
  CASE WHEN abs(current + noncurrent - balance) <= 1 THEN 'OK' ELSE 'DIFERENCIA' END AS verdict FROM register""")
def sql_macros(spark, d):
    """A query in SQL over the register with the engine's formulas as functions."""
    macros.register(spark)
    register(spark, d).createOrReplaceTempView("lb_register")
    return spark.sql("""SELECT obligation_id, round(lb_effective_rate(spread, periods), 8) AS ea, round(lb_compound_interest(balance, lb_effective_rate(spread, periods), 30), 4) AS month_interest,
      lb_verdict(current + noncurrent - balance, 1) AS verdict FROM lb_register""")
