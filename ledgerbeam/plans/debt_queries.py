"""Queries over balances, rates, interest, schedules and classification."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerbeam.functions import finance, schedule
from ledgerbeam.operators import classify, criteria, ordered, recon
from ledgerbeam.plans.tables import BANKED, LEDGER, MONEY, PARAMS, REGISTER, ledger, read, register, with_bank

QUERIES, ORACLES = {}, {}
CUT, NEXT, START = (f"DATE '{x}'" for x in (PARAMS.cutoff, PARAMS.next_year, PARAMS.year_start))
RATES = {"5-LOW": 0.0412345, "1-URGENT": 0.0876543, "2-HIGH": 0.0654321, "3-MEDIUM": 0.0543219}
INDEX = "CASE WHEN starts_with(upper(rate_type), '1-URGENT') THEN 0.0876543 WHEN starts_with(upper(rate_type), '2-HIGH') THEN 0.0654321 WHEN starts_with(upper(rate_type), '3-MEDIUM') THEN 0.0543219 ELSE 0.0412345 END::DOUBLE"
EA = f"(power(1 + ({INDEX} + spread) / periods, periods) - 1)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rated(spark, d):
    """The register with its index and effective annual rate."""
    index = finance.reference_rate(F.col("rate_type"), RATES)
    return register(spark, d).withColumn("idx", index).withColumn("ea", finance.effective_rate(F.col("idx") + F.col("spread"), F.col("periods")))


def dbl(name, *more):
    return [F.col(n).cast("double").alias(n) for n in (name, *more)]


# accounts of the ledger as a trial balance: an opening of 100 for each line, closings that tie but for one account
_BOOK = f"""WITH {LEDGER}, s AS (SELECT account, sum(debit) AS dr, sum(credit) AS cr, CAST(count(*) * 100 AS DECIMAL(18,2)) AS opening FROM ledger GROUP BY 1),
  book AS (SELECT account, opening, CASE WHEN account = 'NO' THEN dr + 2500 ELSE dr END AS debits, cr AS credits, opening + dr - cr AS closing FROM s)"""


def _book(spark, d):
    sums = ledger(spark, d).groupBy("account").agg(F.sum("debit").alias("dr"), F.sum("credit").alias("cr"), (F.count(F.lit(1)) * 100).cast(MONEY).alias("opening"))
    return sums.select("account", "opening", F.when(F.col("account") == "NO", F.col("dr") + 2500).otherwise(F.col("dr")).alias("debits"), F.col("cr").alias("credits"), (F.col("opening") + F.col("dr") - F.col("cr")).alias("closing"))


@query(_BOOK + """ SELECT b.account, (debits - dr)::DOUBLE AS diff_debits, (credits - cr)::DOUBLE AS diff_credits, (closing - (b.opening + dr - cr))::DOUBLE AS diff_closing,
  CASE WHEN greatest(abs(debits - dr), abs(credits - cr), abs(closing - (b.opening + dr - cr))) <= 1000 THEN 'OK' ELSE 'DIFERENCIA' END AS verdict FROM book b JOIN s ON s.account = b.account""")
def tie_out(spark, d):
    """Ledger against trial balance by account."""
    found = recon.tie_out(_book(spark, d), ledger(spark, d), "account", PARAMS.trivial)
    return found.select("account", *dbl("diff_debits", "diff_credits", "diff_closing"), "verdict")


@query(f"""WITH {LEDGER}, s AS (SELECT sum(debit) AS debit, sum(credit) AS credit FROM ledger)
  SELECT m AS measure, r::DOUBLE AS reported, v::DOUBLE AS summed, (r - v)::DOUBLE AS diff, CASE WHEN abs(r - v) <= 1000 THEN 'OK' ELSE 'DIFERENCIA' END AS verdict
  FROM (SELECT 'debit' AS m, debit AS r, debit AS v FROM s UNION ALL SELECT 'credit', credit + 5000, credit FROM s)""")
def control_total(spark, d):
    """A report's grand total against its lines; the credit side is off by 5000."""
    lines = ledger(spark, d)
    control = lines.agg(F.sum("debit").alias("debit"), (F.sum("credit") + 5000).alias("credit"))
    found = recon.control_total(lines, control, ["debit", "credit"], PARAMS.trivial)
    return found.select("measure", *dbl("reported", "summed", "diff"), "verdict")


@query("""WITH c AS (SELECT n_regionkey, n_nationkey, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
  s AS (SELECT n_regionkey, n_nationkey, sum(CAST(s_acctbal AS DECIMAL(18,2))) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2)
  SELECT r_name AS parent, o::DOUBLE AS own, k::DOUBLE AS children, (o - k)::DOUBLE AS diff, CASE WHEN abs(o - k) <= 1000 THEN 'OK' ELSE 'DIFERENCIA' END AS verdict
  FROM (SELECT n_regionkey, sum(v) AS k, sum(v) + CASE WHEN n_regionkey = 2 THEN 1500 ELSE 0 END AS o FROM c GROUP BY 1) JOIN region ON r_regionkey = n_regionkey""")
def hierarchy_proof(spark, d):
    """Region = sum of its nations; one region is off."""
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    customers = read(spark, d, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast(MONEY)).alias("v"))
    leaves = customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("N"), "n_nationkey").alias("node"), "v", "n_regionkey")
    tops = leaves.groupBy("n_regionkey").agg(F.sum("v").alias("v")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    tops = tops.select(F.col("r_name").alias("node"), (F.col("v") + F.when(F.col("r_regionkey") == 2, 1500).otherwise(0)).alias("v"))
    nodes = leaves.select("node", F.col("v").cast("decimal(28,2)").alias("v")).unionByName(tops.select("node", F.col("v").cast("decimal(28,2)").alias("v")))
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.concat(F.lit("N"), "n_nationkey").alias("child"))
    found = recon.hierarchy_proof(nodes, edges, "node", "v", PARAMS.trivial)
    return found.select("parent", *dbl("own", "children", "diff"), "verdict")


@query(f"""WITH {LEDGER}, a AS (SELECT obligation_id, sum(debit) AS dr, sum(credit) AS cr FROM ledger WHERE line_no <= 3 GROUP BY 1),
  b AS (SELECT obligation_id, sum(debit) AS dr, sum(credit) AS cr FROM ledger WHERE line_no >= 3 GROUP BY 1)
  SELECT coalesce(a.obligation_id, b.obligation_id) AS obligation_id, (coalesce(a.dr, 0) - coalesce(b.dr, 0))::DOUBLE AS diff_dr, (coalesce(a.cr, 0) - coalesce(b.cr, 0))::DOUBLE AS diff_cr,
  CASE WHEN b.obligation_id IS NULL THEN 'only in first' WHEN a.obligation_id IS NULL THEN 'only in second' ELSE 'both' END AS status
  FROM a FULL JOIN b ON a.obligation_id = b.obligation_id""")
def version_diff(spark, d):
    """Two versions of a balance, keys of either one included."""
    lines = ledger(spark, d)
    side = lambda c: lines.where(c).groupBy("obligation_id").agg(F.sum("debit").alias("dr"), F.sum("credit").alias("cr"))
    return recon.version_diff(side("line_no <= 3"), side("line_no >= 3"), ["obligation_id"], ["dr", "cr"]).select("obligation_id", *dbl("diff_dr", "diff_cr"), "status")


@query(f"""WITH {LEDGER}, a AS (SELECT account, l_suppkey, sum(debit) AS dr FROM ledger WHERE line_no <= 3 GROUP BY 1, 2), b AS (SELECT account, l_suppkey, sum(debit) AS dr FROM ledger WHERE line_no >= 3 GROUP BY 1, 2)
  SELECT count(*)::BIGINT AS n_both, count(*) FILTER (abs(a.dr - b.dr) > 0.005)::BIGINT AS n_differ FROM a JOIN b USING (account, l_suppkey)""")
def key_intersection(spark, d):
    """Keys in both versions, and those of them that differ."""
    lines = ledger(spark, d)
    key = ["account", "l_suppkey"]
    a, b = (lines.where(c).groupBy(*key).agg(F.sum("debit").alias(n)) for c, n in (("line_no <= 3", "x"), ("line_no >= 3", "y")))
    return a.join(b, key).agg(F.count(F.lit(1)).alias("n_both"), F.count_if(F.abs(F.col("x") - F.col("y")) > 0.005).alias("n_differ"))


@query(f"""WITH {REGISTER}, t AS (SELECT sum(balance) AS w, sum(CASE WHEN status = 'F' THEN balance END) AS f, sum(CASE WHEN status = 'O' THEN balance END) AS o FROM register)
  SELECT 0::INT AS step, 'total' AS item, w::DOUBLE AS amount FROM t UNION ALL SELECT 1, 'finished', f::DOUBLE FROM t UNION ALL SELECT 2, 'open', o::DOUBLE FROM t
  UNION ALL SELECT 3, 'residual', (w - f - o)::DOUBLE FROM t UNION ALL SELECT 4, 'check', 0.0 FROM t""")
def waterfall_residual(spark, d):
    """The total, what explains it, and what is left."""
    r = register(spark, d)
    part = lambda c: r.agg(F.sum(F.when(c, F.col("balance"))).alias("amount"))
    found = recon.waterfall(part(F.lit(True)), [("finished", part(F.col("status") == "F")), ("open", part(F.col("status") == "O"))])
    return found.select("step", "item", *dbl("amount"))


@query("""WITH e AS (SELECT user_id, CAST(value AS DECIMAL(18,2)) AS v, event_type FROM events)
  SELECT user_id, o::DOUBLE AS opening, dr::DOUBLE AS debits, cr::DOUBLE AS credits, (o + dr - cr)::DOUBLE AS closing, (-(o + dr - cr))::DOUBLE AS liability FROM (SELECT user_id,
    coalesce(sum(v) FILTER (event_type = 'login'), 0) AS o, coalesce(sum(v) FILTER (event_type = 'purchase'), 0) AS dr, coalesce(sum(v) FILTER (event_type = 'error'), 0) AS cr FROM e GROUP BY 1)""")
def roll_forward(spark, d):
    """Opening, debits, credits, closing by user."""
    events = read(spark, d, "events").select("user_id", "event_type", F.col("value").cast(MONEY).alias("v"))
    s = lambda kind: criteria.sum_if("v", F.col("event_type") == kind)
    found = events.groupBy("user_id").agg(s("login").alias("opening"), s("purchase").alias("debits"), s("error").alias("credits"))
    found = found.withColumn("closing", recon.roll_forward(F.col("opening"), F.col("debits"), F.col("credits"))).withColumn("liability", -F.col("closing"))
    return found.select("user_id", *dbl("opening", "debits", "credits", "closing", "liability"))


@query(f"WITH {REGISTER}, {BANKED} SELECT obligation_id, bank, round(balance::DOUBLE / nullif(sum(balance) OVER (PARTITION BY bank), 0)::DOUBLE, 8) AS share FROM banked")
def share_of_group(spark, d):
    return with_bank(register(spark, d), spark, d).select("obligation_id", "bank", F.round(ordered.share_of_group("balance", ["bank"]), 8).alias("share"))


_EA6 = f"CAST({EA} AS DECIMAL(18,10))"


@query(f"WITH {REGISTER}, {BANKED} SELECT bank, sum(balance)::DOUBLE AS balance, round(sum(balance * {_EA6})::DOUBLE / nullif(sum(balance), 0)::DOUBLE, 6) AS rate FROM banked GROUP BY ROLLUP (bank)")
def weighted_rate(spark, d):
    """Mean rate by balance, for each bank and in all."""
    rows = with_bank(rated(spark, d), spark, d).withColumn("w", F.col("balance") * F.col("ea").cast("decimal(18,10)"))
    found = rows.rollup("bank").agg(F.sum("balance").cast("double").alias("balance"), F.sum("w").cast("double").alias("w"))
    return found.select("bank", "balance", F.round(F.try_divide("w", "balance"), 6).alias("rate"))


@query(f"""WITH {REGISTER}, {BANKED} SELECT bank, status, (grouping(bank) * 2 + grouping(status))::BIGINT AS level, count(*)::BIGINT AS n, sum(balance)::DOUBLE AS balance, sum(current)::DOUBLE AS current
  FROM banked GROUP BY ROLLUP (bank, status)""")
def subtotal_rollup(spark, d):
    """Rows, subtotals by bank, and the grand total, told apart by `level`."""
    return with_bank(register(spark, d), spark, d).rollup("bank", "status").agg(
        F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"),
        F.sum("balance").cast("double").alias("balance"), F.sum("current").cast("double").alias("current"),
    )


@query(f"WITH {REGISTER} SELECT status, sum(balance)::DOUBLE AS all_, (sum(balance) - coalesce(sum(balance) FILTER (contains(rate_type, 'H')), 0))::DOUBLE AS others FROM register GROUP BY 1")
def complement_total(spark, d):
    """A total less those that match, in one aggregation."""
    return register(spark, d).groupBy("status").agg(F.sum("balance").cast("double").alias("all_"), criteria.sum_if("balance", ~criteria.criterion(F.col("rate_type"), "*H*")).cast("double").alias("others"))


@query(f"WITH {REGISTER} SELECT obligation_id, {INDEX} AS idx FROM register")
def rate_index_choice(spark, d):
    return rated(spark, d).select("obligation_id", "idx")


@query(f"WITH {REGISTER} SELECT obligation_id, round({EA}, 8) AS ea, CASE WHEN round(({EA} - {INDEX}) * 10000, 4) = 0 THEN 0 ELSE round(({EA} - {INDEX}) * 10000, 4) END AS basis_points FROM register")
def effective_rate(spark, d):
    return rated(spark, d).select("obligation_id", F.round("ea", 8).alias("ea"), F.round(finance.basis_points(F.col("ea"), F.col("idx")), 4).alias("basis_points"))


_BILLED = f"""WITH {REGISTER}, b AS (SELECT obligation_id, balance::DOUBLE AS c, {EA} AS ea, (obligation_id % 300 + 1)::INT AS days FROM register),
  i AS (SELECT *, c * (power(1 + ea, days / 365.0) - 1) AS i365, c * (power(1 + ea, days / 360.0) - 1) AS i360 FROM b),
  x AS (SELECT *, CASE WHEN obligation_id % 2 = 0 THEN i365 ELSE i360 END + (obligation_id % 5) AS billed FROM i)"""


def _billed(spark, d):
    rows = rated(spark, d).select("obligation_id", F.col("balance").cast("double").alias("c"), "ea", (F.col("obligation_id") % 300 + 1).cast("int").alias("days"))
    rows = rows.withColumn("i365", finance.compound_interest(F.col("c"), F.col("ea"), F.col("days"), 365)).withColumn("i360", finance.compound_interest(F.col("c"), F.col("ea"), F.col("days"), 360))
    return rows.withColumn("billed", F.when(F.col("obligation_id") % 2 == 0, F.col("i365")).otherwise(F.col("i360")) + (F.col("obligation_id") % 5))


@query(_BILLED + """ SELECT obligation_id, round(i365, 4) AS i365, round(i360, 4) AS i360, round(CASE WHEN abs(i365 - billed) <= abs(i360 - billed) THEN i365 - billed ELSE i360 - billed END, 4) AS diff,
  CASE WHEN abs(CASE WHEN abs(i365 - billed) <= abs(i360 - billed) THEN i365 - billed ELSE i360 - billed END / nullif(billed, 0)) <= 0.02 THEN 'OK' ELSE 'DIFERENCIA' END AS verdict FROM x""")
def compound_interest_best_basis(spark, d):
    """Billed interest against 365 and 360 days, the nearer counts."""
    diff = finance.best_basis(F.col("billed"), F.col("i365"), F.col("i360"))
    return _billed(spark, d).select("obligation_id", F.round("i365", 4).alias("i365"), F.round("i360", 4).alias("i360"), F.round(diff, 4).alias("diff"), recon.verdict(finance.relative(diff, F.col("billed")), PARAMS.interest_tolerance).alias("verdict"))


@query(_BILLED + " SELECT obligation_id, round(power(1 + billed / nullif(c, 0), 365.0 / days) - 1, 6) AS rate FROM x")
def implied_rate(spark, d):
    return _billed(spark, d).select("obligation_id", F.round(finance.implied_rate(F.col("billed"), F.col("c"), F.col("days")), 6).alias("rate"))


@query(_BILLED + " SELECT obligation_id, round(i365 / nullif(power(1 + ea, days / 365.0) - 1, 0), 2) AS principal FROM x")
def implied_principal(spark, d):
    return _billed(spark, d).select("obligation_id", F.round(finance.implied_principal(F.col("i365"), F.col("ea"), F.col("days")), 2).alias("principal"))


@query(f"""WITH {REGISTER} SELECT obligation_id, CASE WHEN contains(upper(rate_type), 'H') THEN 'mensual' ELSE 'trimestral' END AS unit,
  round(power(1 + spread, CASE WHEN contains(upper(rate_type), 'H') THEN 12 ELSE 4 END) - 1, 8) AS ea FROM register""")
def period_rate(spark, d):
    unit = F.when(F.upper("rate_type").contains("H"), "mensual").otherwise("trimestral")
    return register(spark, d).select("obligation_id", unit.alias("unit"), F.round(finance.period_rate_to_ea(F.col("spread"), unit), 8).alias("ea"))


@query(f"WITH {REGISTER} SELECT obligation_id, least(greatest(current, 0), balance)::DOUBLE AS current, (balance - least(greatest(current, 0), balance))::DOUBLE AS noncurrent FROM register")
def clamp_current_portion(spark, d):
    current = classify.clamp(F.col("current"), F.col("balance"))
    return register(spark, d).select("obligation_id", current.cast("double").alias("current"), (F.col("balance") - current).cast("double").alias("noncurrent"))


@query(f"""WITH {REGISTER}, s AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS due FROM lineitem WHERE CAST(l_shipdate AS DATE) > {CUT} AND CAST(l_shipdate AS DATE) <= {NEXT} GROUP BY 1)
  SELECT obligation_id, CASE WHEN balance <= 0 THEN 0 WHEN maturity <= {NEXT} THEN balance WHEN due IS NOT NULL THEN least(greatest(due, 0), balance) ELSE least(greatest(current, 0), balance) END::DOUBLE AS amount,
  CASE WHEN balance <= 0 THEN 'no balance' WHEN maturity <= {NEXT} THEN 'matures within twelve months' WHEN due IS NOT NULL THEN 'schedule' ELSE 'ledger' END AS reason
  FROM register LEFT JOIN s ON l_orderkey = obligation_id""")
def classification_waterfall(spark, d):
    """Current portion by maturity, schedule or ledger, with the reason."""
    date = F.col("entry_date")
    due = ledger(spark, d).where((date > F.lit(PARAMS.cutoff)) & (date <= F.lit(PARAMS.next_year))).groupBy("obligation_id").agg(F.sum("amount").alias("due"))
    found = register(spark, d).join(due, "obligation_id", "left")
    portion = classify.current_portion(F.col("balance"), classify.maturity(F.lit(None).cast("date"), F.col("maturity")), F.col("due"), F.col("current"), PARAMS.next_year)
    return found.select("obligation_id", portion.alias("p")).select("obligation_id", F.col("p.amount").cast("double").alias("amount"), "p.reason")


@query(f"""WITH {REGISTER} SELECT * FROM (SELECT obligation_id, CASE WHEN current < 0 THEN 'negative current portion' WHEN noncurrent < 0 THEN 'negative non-current portion' WHEN current > balance THEN 'current portion over balance'
  WHEN abs(current + noncurrent - balance) > 1 THEN 'portions do not add up' END AS fault FROM register) WHERE fault IS NOT NULL""")
def register_errors(spark, d):
    fault = classify.register_fault(F.col("balance"), F.col("current"), F.col("noncurrent"))
    return register(spark, d).select("obligation_id", fault.alias("fault")).where("fault is not null")


# one period for each line of an order, in a total order
_LINES = f"""WITH {LEDGER}, p AS (SELECT obligation_id, row_number() OVER (PARTITION BY obligation_id ORDER BY entry_date, line_no, l_partkey, l_suppkey, amount) AS k, entry_date, amount::DOUBLE AS payment, rate + 0.0012345678::DOUBLE AS rate FROM ledger),
  s AS (SELECT p.*, CAST(o_totalprice AS DOUBLE) AS opening, 0.0123456789::DOUBLE AS n FROM p JOIN orders ON o_orderkey = obligation_id)"""


def _lines(spark, d):
    order = W.partitionBy("obligation_id").orderBy("entry_date", "line_no", "l_partkey", "l_suppkey", "amount")
    rows = ledger(spark, d).select("obligation_id", F.row_number().over(order).cast("long").alias("k"), "entry_date", F.col("amount").cast("double").alias("payment"), (F.col("rate") + 0.0012345678).alias("rate"))
    return rows.join(read(spark, d, "orders").select(F.col("o_orderkey").alias("obligation_id"), F.col("o_totalprice").cast("double").alias("opening")), "obligation_id").withColumn("n", F.lit(0.0123456789))


@query(_LINES + """, c AS (SELECT *, power(1 + n, k) * (opening - sum(payment / power(1 + n, k)) OVER (PARTITION BY obligation_id ORDER BY k ROWS UNBOUNDED PRECEDING)) AS close FROM s)
  SELECT obligation_id, k, round(close, 4) AS balance_close, round((close + payment) / (1 + n) * n, 4) AS interest FROM c""")
def schedule_closed_form(spark, d):
    """Leases of a constant rate by one running sum."""
    found = schedule.lease_closed_form(_lines(spark, d), "obligation_id", "k", "payment", "opening", "n")
    return found.select("obligation_id", "k", F.round("balance_close", 4).alias("balance_close"), F.round("interest", 4).alias("interest"))


@query(_LINES.replace("WITH ledger", "WITH RECURSIVE ledger") + """, r AS (SELECT obligation_id, k, opening * rate AS i, opening + opening * rate - payment AS j FROM s WHERE k = 1
  UNION ALL SELECT s.obligation_id, s.k, r.j * s.rate, r.j + r.j * s.rate - s.payment FROM r JOIN s ON s.obligation_id = r.obligation_id AND s.k = r.k + 1)
  SELECT obligation_id, k, round(j, 4) AS balance_close, CASE WHEN round(i, 4) = 0 THEN 0 ELSE round(i, 4) END AS interest FROM r""")
def schedule_recurrence(spark, d):
    """Rates that change from period to period, by a fold over each schedule."""
    found = schedule.recurrence(_lines(spark, d), "obligation_id", "k", "payment", "opening", "rate")
    return found.select("obligation_id", "k", F.round("balance_close", 4).alias("balance_close"), F.round("interest", 4).alias("interest"))


@query(_LINES + """, c AS (SELECT *, CAST(opening AS DECIMAL(18,2)) - sum(CAST(payment AS DECIMAL(18,2))) OVER (PARTITION BY obligation_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS close FROM s)
  SELECT obligation_id, k, close::DOUBLE AS balance_close, (close + CAST(payment AS DECIMAL(18,2)))::DOUBLE AS balance_open FROM c""")
def loan_running_balance(spark, d):
    rows = _lines(spark, d).withColumn("payment", F.col("payment").cast(MONEY)).withColumn("opening", F.col("opening").cast(MONEY))
    return schedule.loan_running(rows, "obligation_id", "k", "payment", "opening", "rate").select("obligation_id", "k", *dbl("balance_close", "balance_open"))


@query(_LINES + f""", m AS (SELECT *, max(CASE WHEN entry_date <= {CUT} THEN entry_date END) OVER (PARTITION BY obligation_id) AS last, CAST(payment AS DECIMAL(18,2)) AS p2 FROM s)
  SELECT obligation_id, max(last) AS last_date, coalesce(sum(CASE WHEN entry_date = last THEN p2 END), 0)::DOUBLE AS balance_at_cutoff,
  coalesce(sum(CASE WHEN entry_date >= {START} AND entry_date <= {CUT} THEN p2 END), 0)::DOUBLE AS interest_to_cutoff,
  coalesce(sum(CASE WHEN entry_date > {CUT} AND entry_date <= {NEXT} THEN p2 END), 0)::DOUBLE AS capital_next_year, max(abs(payment - opening)) AS max_abs_diff FROM m GROUP BY 1""")
def annex_scalars(spark, d):
    """One row for each schedule: its last date, balance, interest, capital and largest difference."""
    rows = _lines(spark, d).withColumn("p2", F.col("payment").cast(MONEY)).withColumn("diff", F.col("payment") - F.col("opening"))
    found = schedule.annex_scalars(rows, "obligation_id", "entry_date", PARAMS.cutoff, PARAMS.year_start, PARAMS.next_year, "p2", "p2", "p2", "diff")
    return found.select("obligation_id", "last_date", *dbl("balance_at_cutoff", "interest_to_cutoff", "capital_next_year"), "max_abs_diff")


@query(f"""WITH {LEDGER} SELECT obligation_id, count(*) FILTER (entry_date >= {START} AND entry_date <= {CUT})::BIGINT AS n_year, count(*) FILTER (entry_date > {CUT} AND entry_date <= {NEXT})::BIGINT AS n_next,
  max(datediff('day', entry_date, {CUT}))::INT AS oldest_days FROM ledger GROUP BY 1""")
def period_flags(spark, d):
    date, lit = F.col("entry_date"), F.lit
    return ledger(spark, d).groupBy("obligation_id").agg(
        F.count_if((date >= lit(PARAMS.year_start)) & (date <= lit(PARAMS.cutoff))).alias("n_year"),
        F.count_if((date > lit(PARAMS.cutoff)) & (date <= lit(PARAMS.next_year))).alias("n_next"),
        F.max(F.datediff(lit(PARAMS.cutoff), date)).alias("oldest_days"),
    )


@query(f"WITH {LEDGER} SELECT account, max(abs(debit - credit))::DOUBLE AS max_abs FROM ledger GROUP BY 1")
def max_abs_diff(spark, d):
    return ledger(spark, d).groupBy("account").agg(F.max(F.abs(F.col("debit") - F.col("credit"))).cast("double").alias("max_abs"))


@query(_LINES.replace("WITH ledger", "WITH RECURSIVE ledger") + """, t AS (SELECT obligation_id, sum(payment) AS total, list(payment ORDER BY k) AS pays FROM s GROUP BY 1),
  f AS (SELECT obligation_id, list_concat([-total * 0.6], pays) AS flows FROM t),
  z AS (SELECT *, sign(list_sum(list_transform(flows, lambda x, i: x * power(10.0, i - 1)))) AS s_low, sign(list_sum(list_transform(flows, lambda x, i: x * power(1 / 11.0, i - 1)))) AS s_high FROM f),
  b AS (SELECT obligation_id, flows, s_low, -0.9::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0 AS i FROM z UNION ALL
    SELECT obligation_id, flows, s_low, CASE WHEN v = s_low THEN mid ELSE lo END, CASE WHEN v = s_low THEN hi ELSE mid END, i + 1
    FROM (SELECT *, (lo + hi) / 2 AS mid, sign(list_sum(list_transform(flows, lambda x, j: x * power(1 / (1 + (lo + hi) / 2), j - 1)))) AS v FROM b WHERE i < 60)),
  g AS (SELECT z.obligation_id, len(z.flows)::INT AS n_flows, CASE WHEN z.s_low * z.s_high < 0 THEN (lo + hi) / 2 END AS irr FROM z JOIN b ON b.obligation_id = z.obligation_id AND b.i = 60)
  SELECT obligation_id, n_flows, round(irr, 8) AS irr, round(power(1 + irr, 12) - 1, 6) AS irr_ea FROM g""")
def irr_bisection(spark, d):
    """Internal rate of each order's lines against its principal: 60 % of their sum, so that a rate exists."""
    rows = _lines(spark, d).groupBy("obligation_id").agg(F.array_sort(F.collect_list(F.struct("k", "payment"))).alias("s"), F.sum("payment").alias("total"))
    flows = F.concat(F.array(-F.col("total") * 0.6), F.transform("s", lambda x: x["payment"]))
    with_flows = rows.select("obligation_id", flows.alias("flows"))
    return with_flows.select("obligation_id", F.size("flows").alias("n_flows"), finance.irr(F.col("flows")).alias("irr")).select(
        "obligation_id", "n_flows", F.round("irr", 8).alias("irr"), F.round(finance.period_rate_to_ea(F.col("irr"), F.lit("MENSUAL")), 6).alias("irr_ea")
    )


@query(f"""WITH {REGISTER}, y AS (SELECT year(start) AS y, sum(balance)::DOUBLE AS b FROM register GROUP BY 1), r AS (SELECT avg(CAST({EA} AS DECIMAL(18,10)))::DOUBLE AS ea FROM register),
  x AS (SELECT y AS year_, b, (b + coalesce(lag(b) OVER (ORDER BY y), b)) / 2 * (power(1 + round(ea, 8), 181 / 365.0) - 1) AS e FROM y, r)
  SELECT year_::INT AS year_, round(e, 2) AS expected, CASE WHEN abs((b * 0.03 - e) / nullif(e, 0)) <= 0.1 THEN 'OK' ELSE 'DIFERENCIA' END AS verdict FROM x""")
def analytic_expectation(spark, d):
    """Expected interest of each year's mean balance at the mean rate."""
    rate = rated(spark, d).agg(F.round(F.sum(F.col("ea").cast("decimal(18,10)")).cast("double") / F.count(F.lit(1)), 8).alias("ea"))
    years = register(spark, d).groupBy(F.year("start").alias("year_")).agg(F.sum("balance").cast("double").alias("b"))
    before = F.lag("b").over(W.orderBy("year_"))
    rows = years.withColumn("before", before).crossJoin(F.broadcast(rate))  # one row
    e = finance.expected_interest(F.col("before"), F.col("b"), F.col("ea"), F.lit(181))
    rows = rows.withColumn("e", e)
    return rows.select("year_", F.round("e", 2).alias("expected"), recon.verdict(finance.relative(F.col("b") * 0.03 - F.col("e"), F.col("e")), PARAMS.analytic_tolerance).alias("verdict"))


_FOUR = f"""WITH {REGISTER}, {LEDGER}, l AS (SELECT obligation_id, sum(debit) AS dr, sum(credit) AS cr FROM ledger GROUP BY 1),
  x AS (SELECT r.obligation_id, r.status, r.balance AS reg, coalesce(dr, 0) AS dr, coalesce(cr, 0) AS cr, CASE WHEN r.status = 'F' THEN balance + (r.obligation_id % 3) * 900 END AS cert, CASE WHEN r.status = 'O' THEN balance - 10000 END AS stmt FROM register r LEFT JOIN l ON l.obligation_id = r.obligation_id),
  b AS (SELECT *, coalesce(cert, stmt + cr - dr) AS bank, CASE WHEN cert IS NOT NULL THEN '[C]' WHEN stmt IS NOT NULL THEN '[E]' ELSE '[P]' END AS evidence, reg + CASE WHEN obligation_id % 4 = 0 THEN 5000 ELSE 0 END AS led FROM x)"""


def four_balances(spark, d):
    """Each obligation's balance by ledger, register and bank, the bank's certified or estimated."""
    spine = register(spark, d).select("obligation_id", "status", F.col("balance").alias("reg"))
    found = criteria.attach(spine, ledger(spark, d), ["obligation_id"], dr=F.sum("debit"), cr=F.sum("credit"))
    key = F.col("obligation_id")
    found = found.withColumn("cert", F.when(F.col("status") == "F", F.col("reg") + (key % 3) * 900)).withColumn("stmt", F.when(F.col("status") == "O", F.col("reg") - 10000))
    bank, mark = recon.bank_balance(F.col("cert"), F.col("stmt"), F.col("cr"), F.col("dr"))
    return found.withColumn("bank", bank).withColumn("evidence", mark).withColumn("led", F.col("reg") + F.when(key % 4 == 0, 5000).otherwise(0))


@query(_FOUR + """ SELECT obligation_id, evidence, led::DOUBLE AS ledger, reg::DOUBLE AS register, bank::DOUBLE AS bank, (led - bank)::DOUBLE AS diff_bank,
  CASE WHEN bank IS NULL THEN 'pending' WHEN abs(led - bank) <= 1000 AND abs(led - reg) <= 1000 THEN 'OK' WHEN abs(led - bank) <= 1000 THEN 'register stale' ELSE 'difference' END AS conclusion FROM b""")
def balance_by_obligation(spark, d):
    found = four_balances(spark, d)
    conclusion = recon.balance_conclusion(F.col("led"), F.col("bank"), F.col("reg"), PARAMS.trivial)
    return found.select("obligation_id", "evidence", F.col("led").cast("double").alias("ledger"), F.col("reg").cast("double").alias("register"), F.col("bank").cast("double").alias("bank"), (F.col("led") - F.col("bank")).cast("double").alias("diff_bank"), conclusion.alias("conclusion"))


@query(f"""WITH {LEDGER}, x AS (SELECT account, sum(debit - credit) AS a, max(debit) AS b FROM ledger GROUP BY 1)
  SELECT account, CASE WHEN abs(a) <= 1000 THEN 'OK' ELSE 'DIFERENCIA' END AS by_sum, CASE WHEN greatest(abs(a), abs(b)) <= 90000000 THEN 'OK' ELSE 'DIFERENCIA' END AS by_worst FROM x""")
def tolerance_verdict(spark, d):
    sums = ledger(spark, d).groupBy("account").agg(F.sum(F.col("debit") - F.col("credit")).alias("a"), F.max("debit").alias("b"))
    return sums.select("account", recon.verdict(F.col("a"), PARAMS.trivial).alias("by_sum"), recon.worst_verdict(90000000, F.col("a"), F.col("b")).alias("by_worst"))


@query(f"WITH {LEDGER} SELECT line_no AS entry, sum(debit)::DOUBLE AS debits, sum(credit)::DOUBLE AS credits, sum(debit) = sum(credit) AS balanced FROM ledger GROUP BY 1")
def dr_cr_proof(spark, d):
    found = recon.dr_cr_proof(ledger(spark, d).withColumnRenamed("line_no", "entry"), "entry")
    return found.select("entry", *dbl("debits", "credits"), "balanced")


@query(f"""WITH {REGISTER}, {LEDGER}, f AS (SELECT obligation_id, count(*) FILTER (amount > 90000) AS large, count(*) AS n FROM ledger GROUP BY 1)
  SELECT r.obligation_id, coalesce(large, 0)::BIGINT AS open_items, CASE WHEN coalesce(large, 0) > 0 THEN 'pending' ELSE 'concluded' END AS state,
  CASE WHEN status = 'F' THEN 'Recibido' ELSE 'Pendiente' END AS receipt FROM register r LEFT JOIN f ON f.obligation_id = r.obligation_id""")
def findings_status(spark, d):
    """A finding is pending while it has open items; an item is closed only once received."""
    counted = criteria.countifs(register(spark, d).select("obligation_id", "status"), ledger(spark, d), ["obligation_id"], "open_items", amount=">90000")
    receipt = F.coalesce(F.when(F.col("status") == "F", "Recibido"), F.lit("Pendiente"))
    return counted.select("obligation_id", "open_items", F.when(F.col("open_items") > 0, "pending").otherwise("concluded").alias("state"), receipt.alias("receipt"))


