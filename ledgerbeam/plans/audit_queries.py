"""Queries for the parts of a review that gather others: proofs, tie-outs, findings, open items, dashboard, workpaper."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerbeam.functions import finance
from ledgerbeam.operators import classify, criteria, recon, rules
from ledgerbeam.plans.debt_queries import _FOUR, _LINES, EA, INDEX, _lines, four_balances, rated
from ledgerbeam.plans.tables import BANKED, LEDGER, MONEY, PARAMS, REGISTER, ledger, read, register, with_bank

QUERIES, ORACLES = {}, {}
CUT, NEXT = f"DATE '{PARAMS.cutoff}'", f"DATE '{PARAMS.next_year}'"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def dbl(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


def _verdict(diff: str, limit=1000) -> str:
    return f"CASE WHEN {diff} IS NULL THEN 'pending' WHEN abs({diff}) <= {limit} THEN 'OK' ELSE 'DIFERENCIA' END"


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 11 = 0 THEN 'reclassification' WHEN l_partkey % 11 = 1 THEN 'card'
    WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_partkey % 11 = 2 THEN 'accrual' WHEN l_partkey % 11 = 3 THEN 'rounding' ELSE 'reversal' END
    WHEN l_partkey % 11 = 2 THEN 'drawdown' WHEN l_partkey % 11 = 4 THEN 'renewal' ELSE 'principal payment' END AS movement FROM lineitem""")
def movement_outcomes(spark, d):
    """All outcomes of the movement rules: accounts, sides and amounts follow from a line's keys."""
    kind, lit = F.col("l_partkey") % 11, F.lit
    account = F.when(F.col("l_suppkey") % 2 == 0, "213005").otherwise("210510")
    obligation = F.when(kind == 0, "N/A-7").when(kind == 1, "TC").otherwise("O-1")
    credit = F.when(kind == 2, 50).when((kind == 4) & (F.col("l_suppkey") % 2 == 1), 70)
    debit = F.when(kind == 3, 999).when(kind == 4, 1000).when(kind > 4, 5000 * (kind % 2) + 1000)
    movement = rules.movement_type(account, debit.cast(MONEY), credit.cast(MONEY), F.coalesce(obligation, lit("")))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", movement.alias("movement"))


ACCOUNTS = ("RF", "AF", "NO")


@query(f"""WITH {LEDGER}, s AS (SELECT obligation_id, sum(amount) FILTER (account IN ('RF', 'AF', 'NO') AND credit > 0) AS cr, sum(amount) FILTER (account IN ('RF', 'AF', 'NO') AND debit > 0) AS dr FROM ledger GROUP BY 1)
  SELECT o_orderkey AS obligation_id, coalesce(cr, 0)::DOUBLE AS credits, coalesce(dr, 0)::DOUBLE AS debits FROM orders LEFT JOIN s ON obligation_id = o_orderkey""")
def sumifs_account_set(spark, d):
    """Sums over a set of accounts, each a criterion of its own, in one aggregation."""
    part = lambda side: sum((criteria.sum_if("amount", criteria.all_of({"account": a, side: ">0"})) for a in ACCOUNTS), F.lit(0))
    found = criteria.attach(register(spark, d).select("obligation_id"), ledger(spark, d), ["obligation_id"], credits=part("credit"), debits=part("debit"))
    return found.select("obligation_id", F.coalesce("credits", F.lit(0)).cast("double").alias("credits"), F.coalesce("debits", F.lit(0)).cast("double").alias("debits"))


_SIDES = f"WITH {LEDGER}, s AS (SELECT account AS a, sum(debit) AS dr, sum(credit) AS cr, sum(amount) AS t FROM ledger GROUP BY 1), w AS (SELECT " + ", ".join(
    f"coalesce(sum({c}) FILTER ({w}), 0) AS {n}"
    for n, c, w in [("t", "t", "true"), ("dr", "dr", "true"), ("cr", "cr", "true"), ("r", "t", "a LIKE 'R%'"), ("rf", "t", "a = 'RF'"), ("a", "t", "a LIKE 'A%'"), ("af", "t", "a = 'AF'"), ("n", "t", "a LIKE 'N%'"), ("nf", "t", "a = 'NF'"), ("no", "t", "a = 'NO'"), ("f", "t", "a LIKE '%F'"), ("o", "t", "a LIKE '%O'")]
) + " FROM s)"
#: Name of a proof, and its two sides over the sums of `_sides`.
PROOFS = [
    ("assets = liabilities + equity", "t", "dr + cr"), ("R = RF", "r", "rf"), ("A = AF", "a", "af"), ("N = NF + NO", "n", "nf + no"), ("total = R + A + N", "t", "r + a + n"),
    ("total = F + O", "t", "f + o"), ("debits = R", "dr", "r"), ("credits = A + N", "cr", "a + n"), ("liability NO = expense AF", "no", "af"), ("open = NO", "o", "no"),
]


def _sides(spark, d):
    total = lambda **w: criteria.sum_if("amount", criteria.all_of(w))
    return ledger(spark, d).agg(
        total().alias("t"), criteria.sum_if("debit", F.lit(True)).alias("dr"), criteria.sum_if("credit", F.lit(True)).alias("cr"), total(account="R*").alias("r"), total(account="RF").alias("rf"),
        total(account="A*").alias("a"), total(account="AF").alias("af"), total(account="N*").alias("n"), total(account="NF").alias("nf"), total(account="NO").alias("no"),
        total(account="*F").alias("f"), total(account="*O").alias("o"),
    )


@query(_SIDES + " SELECT no_::INT AS no, proof, x::DOUBLE AS left_side, y::DOUBLE AS right_side, (x - y)::DOUBLE AS diff, " + _verdict("(x - y)") + " AS verdict FROM (" + " UNION ALL ".join(f"SELECT {i} AS no_, '{p}' AS proof, {x} AS x, {y} AS y FROM w" for i, (p, x, y) in enumerate(PROOFS, 1)) + ")")
def relation_proofs(spark, d):
    """Ten proofs over one aggregation: the accounting equation, parents against children, a liability against its expense."""
    line = lambda i, p, x, y: F.struct(F.lit(i).alias("no"), F.lit(p).alias("proof"), F.expr(x).cast("decimal(30,2)").alias("x"), F.expr(y).cast("decimal(30,2)").alias("y"))
    rows = _sides(spark, d).select(F.inline(F.array(*[line(i, *p) for i, p in enumerate(PROOFS, 1)])))
    diff = F.col("x") - F.col("y")
    return rows.select("no", "proof", F.col("x").cast("double").alias("left_side"), F.col("y").cast("double").alias("right_side"), diff.cast("double").alias("diff"), recon.verdict(diff, PARAMS.trivial).alias("verdict"))


@query(f"""WITH {REGISTER}, x AS (SELECT *, {INDEX} AS idx, {EA} AS ea, least(greatest(current, 0), balance) AS cur FROM register)
  SELECT obligation_id, idx, round(ea, 8) AS ea, round((ea - idx) * 10000, 4) + 0 AS basis_points, cur::DOUBLE AS current, (balance - cur)::DOUBLE AS noncurrent, round(balance::DOUBLE / sum(balance) OVER (PARTITION BY status)::DOUBLE, 8) AS share,
    CASE WHEN current < 0 THEN 'negative current portion' WHEN noncurrent < 0 THEN 'negative non-current portion' WHEN current > balance THEN 'current portion over balance' WHEN abs(current + noncurrent - balance) > 1 THEN 'portions do not add up' ELSE 'ok' END AS state FROM x""")
def register_recalculation(spark, d):
    """The register recalculated in one result: rates, portions, shares and what is wrong with a row."""
    sums = register(spark, d).groupBy("status").agg(F.sum("balance").cast("double").alias("whole"))
    current = classify.clamp(F.col("current"), F.col("balance"))
    fault = F.coalesce(classify.register_fault(F.col("balance"), F.col("current"), F.col("noncurrent")), F.lit("ok"))
    rows = rated(spark, d).join(sums, "status")
    points = F.round(finance.basis_points(F.col("ea"), F.col("idx")), 4) + 0.0
    return rows.select(
        "obligation_id", "idx", F.round("ea", 8).alias("ea"), points.alias("basis_points"), current.cast("double").alias("current"), (F.col("balance") - current).cast("double").alias("noncurrent"),
        F.round(F.try_divide(F.col("balance").cast("double"), F.col("whole")), 8).alias("share"), fault.alias("state"),
    )


_OPENING = """CASE WHEN right(o_orderpriority, 1) = 'H' THEN 'TC' WHEN starts_with(o_orderpriority, '1') THEN CASE WHEN o_orderkey % 3 = 0 THEN 'L-0001' ELSE 'SIN-ID' END WHEN o_orderstatus = 'F' THEN 'RULE-F' WHEN o_orderkey = 7 THEN 'ROW-7' ELSE 'SIN-ID' END"""


@query(f"""WITH o AS (SELECT {_OPENING} AS opening_id, CAST(o_totalprice AS DECIMAL(18,2)) AS b FROM orders), s AS (SELECT opening_id, count(*) AS n, sum(b) AS detail, sum(b) + CASE WHEN opening_id = 'RULE-F' THEN 5000 ELSE 0 END AS opening FROM o GROUP BY 1)
  SELECT opening_id, n::BIGINT AS n_lines, detail::DOUBLE AS detail, opening::DOUBLE AS opening, (detail - opening)::DOUBLE AS diff, {_verdict('(detail - opening)')} AS verdict FROM s""")
def opening_tie_out(spark, d):
    """A prior year's lines by obligation against its opening balances; those of one rule are off."""
    from ledgerbeam.plans.ledger_queries import opening_classify

    lines = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast(MONEY).alias("b")).join(opening_classify(spark, d), "o_orderkey")
    sums = lines.groupBy("opening_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("b").alias("detail"))
    found = sums.withColumn("opening", F.col("detail") + F.when(F.col("opening_id") == "RULE-F", 5000).otherwise(0)).withColumn("diff", F.col("detail") - F.col("opening"))
    return found.select("opening_id", "n_lines", *dbl("detail", "opening", "diff"), recon.verdict(F.col("diff"), PARAMS.trivial).alias("verdict"))


@query(_FOUR + f""" SELECT obligation_id, (led - cr + dr)::DOUBLE AS implied_opening, (reg - cr + dr)::DOUBLE AS register_opening, (led - reg)::DOUBLE AS diff, {_verdict('(led - reg)')} AS verdict FROM b""")
def implied_opening(spark, d):
    """Ledger and register rolled back over the year's movements to the openings that they imply."""
    back = lambda c: recon.roll_forward(F.col(c), F.col("dr"), F.col("cr")).cast("double")
    diff = F.col("led") - F.col("reg")
    return four_balances(spark, d).select("obligation_id", back("led").alias("implied_opening"), back("reg").alias("register_opening"), diff.cast("double").alias("diff"), recon.verdict(diff, PARAMS.trivial).alias("verdict"))


_KIND = "CASE WHEN contains(rate_type, 'H') THEN 'lease' ELSE 'credit' END"
#: Interest accounts of leases and credits.
INTEREST = {"lease": "213002", "credit": "213001"}
_ACCRUED = f"""WITH {LEDGER}, {REGISTER}, a AS (SELECT obligation_id, CASE WHEN {_KIND} = 'lease' THEN '213002' ELSE '213001' END AS account, CAST(round(balance::DOUBLE * (power(1 + {INDEX}, datediff('day', start, maturity) / 365.0) - 1), 2) AS DECIMAL(20,2)) AS accrued FROM register),
  l AS (SELECT obligation_id, sum(credit) FILTER (account = 'NO') AS booked FROM ledger GROUP BY 1)"""


def _accrued(spark, d):
    """Accrual of each obligation, its account by kind, and what the ledger has booked."""
    lease = F.when(F.col("rate_type").contains("H"), F.lit("X-L1")).otherwise(F.lit("X-1"))
    kind = rules.obligation_kind(lease)
    account = F.when(kind == "lease", INTEREST["lease"]).otherwise(INTEREST["credit"])
    accrued = F.round(finance.compound_interest(F.col("balance").cast("double"), F.col("idx"), F.datediff("maturity", "start")), 2).cast("decimal(20,2)")
    spine = rated(spark, d).select("obligation_id", kind.alias("kind"), account.alias("account"), accrued.alias("accrued"))
    booked = criteria.sum_if("credit", F.col("account") == "NO")
    return criteria.attach(spine, ledger(spark, d), ["obligation_id"], booked=booked)


@query(_ACCRUED + f""", s AS (SELECT a.account, count(*) AS n, sum(accrued) AS accrued, sum(coalesce(booked, 0)) AS booked FROM a LEFT JOIN l ON l.obligation_id = a.obligation_id GROUP BY 1)
  SELECT account, n::BIGINT AS n, accrued::DOUBLE AS accrued, booked::DOUBLE AS booked, (booked - accrued)::DOUBLE AS diff, {_verdict('(booked - accrued)')} AS verdict FROM s""")
def accrual_by_account(spark, d):
    """Accruals by interest account, leases and credits apart, against the balances."""
    sums = _accrued(spark, d).groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.sum("accrued").alias("accrued"), F.sum("booked").alias("booked"))
    diff = F.col("booked") - F.col("accrued")
    return sums.select("account", "n", *dbl("accrued", "booked"), diff.cast("double").alias("diff"), recon.verdict(diff, PARAMS.trivial).alias("verdict"))


@query(f"""WITH {LEDGER}, {REGISTER}, o AS (SELECT coalesce(sum(credit) FILTER (account = 'NO'), 0) AS a, coalesce(sum(credit) FILTER (account <> 'NO'), 0) AS b FROM ledger WHERE obligation_id IN (SELECT obligation_id FROM register WHERE status <> 'P')),
  t AS (SELECT coalesce(sum(credit) FILTER (account = 'NO'), 0) AS a, coalesce(sum(credit) FILTER (account <> 'NO'), 0) AS b FROM ledger)
  SELECT m AS measure, x::DOUBLE AS by_obligation, y::DOUBLE AS ledger, (y - x)::DOUBLE AS diff, {_verdict('(y - x)')} AS verdict FROM (SELECT 'accrued' AS m, o.a AS x, t.a AS y FROM o, t UNION ALL SELECT 'expense', o.b, t.b FROM o, t)""")
def interest_tie_out(spark, d):
    """Interest summed by obligation against the two accounts of the ledger; obligations of one status are missing."""
    accrued, other = (criteria.sum_if("credit", c) for c in (F.col("account") == "NO", F.col("account") != "NO"))
    lines = ledger(spark, d)
    spine = register(spark, d).where("status <> 'P'").select("obligation_id")
    by_obligation = criteria.attach(spine, lines, ["obligation_id"], accrued=accrued, expense=other)
    sums = by_obligation.agg(F.sum("accrued").alias("x1"), F.sum("expense").alias("x2")).crossJoin(lines.agg(accrued.alias("y1"), other.alias("y2")))  # one row each
    line = lambda name, x, y: F.struct(F.lit(name).alias("measure"), F.coalesce(F.col(x), F.lit(0)).alias("x"), F.col(y).alias("y"))
    rows = sums.select(F.inline(F.array(line("accrued", "x1", "y1"), line("expense", "x2", "y2"))))
    diff = F.col("y") - F.col("x")
    return rows.select("measure", F.col("x").cast("double").alias("by_obligation"), F.col("y").cast("double").alias("ledger"), diff.cast("double").alias("diff"), recon.verdict(diff, PARAMS.trivial).alias("verdict"))


_FAULT = "CASE WHEN current < 0 THEN 'negative current portion' WHEN noncurrent < 0 THEN 'negative non-current portion' WHEN current > balance THEN 'current portion over balance' WHEN abs(current + noncurrent - balance) > 1 THEN 'portions do not add up' END"


@query(f"""WITH {REGISTER}, {BANKED}, f AS (SELECT bank, {_FAULT} AS fault, balance, status, obligation_id FROM banked)
  SELECT dense_rank() OVER (ORDER BY fault)::INT AS ref, bank, fault, count(*)::BIGINT AS n, sum(balance)::DOUBLE AS amount, min(obligation_id) AS first_obligation, count(*) FILTER (status = 'O')::BIGINT AS n_open, CASE WHEN count(*) FILTER (status = 'O') > 0 THEN 'pending' ELSE 'concluded' END AS state FROM f WHERE fault IS NOT NULL GROUP BY fault, bank""")
def findings_list(spark, d):
    """Findings with reference, bank, amount, an obligation to start from, open items and state."""
    fault = classify.register_fault(F.col("balance"), F.col("current"), F.col("noncurrent"))
    rows = with_bank(register(spark, d), spark, d).select("bank", "balance", "status", "obligation_id", fault.alias("fault")).where("fault is not null")
    sums = rows.groupBy("fault", "bank").agg(F.count(F.lit(1)).alias("n"), F.sum("balance").cast("double").alias("amount"), F.min("obligation_id").alias("first_obligation"), F.count_if(F.col("status") == "O").alias("n_open"))
    state = F.when(F.col("n_open") > 0, "pending").otherwise("concluded")
    return sums.select(F.dense_rank().over(W.orderBy("fault")).alias("ref"), "bank", "fault", "n", "amount", "first_obligation", "n_open", state.alias("state"))  # a row for each fault and bank


@query(f"""WITH {REGISTER}, {BANKED}, i AS (SELECT bank, obligation_id, balance, CASE WHEN status = 'F' THEN 'Recibido' ELSE 'Pendiente' END AS status, CASE WHEN maturity <= {NEXT} THEN 'client' ELSE 'bank' END AS owner FROM banked WHERE balance > 200000)
  SELECT bank, owner, count(*)::BIGINT AS n_items, count(*) FILTER (status = 'Pendiente')::BIGINT AS n_open, coalesce(sum(balance) FILTER (status = 'Pendiente'), 0)::DOUBLE AS open_amount FROM i GROUP BY ROLLUP (bank, owner)""")
def open_items_summary(spark, d):
    """Open items by bank and owner, with subtotals and the open count in all."""
    rows = with_bank(register(spark, d), spark, d).where("balance > 200000")
    is_open = F.col("status") != "F"
    rows = rows.withColumn("owner", F.when(F.col("maturity") <= F.lit(PARAMS.next_year), "client").otherwise("bank"))
    return rows.rollup("bank", "owner").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(is_open).alias("n_open"), criteria.sum_if("balance", is_open).cast("double").alias("open_amount"))


#: Tests of the dashboard over the values of `_overview`: name, value, threshold.
TESTS = [
    ("net movement", "net", 1000), ("total of the ledger", "lines - debits - credits", 1000), ("portions against balance", "portions", 1000), ("negative balances", "negative", 0), ("faulty rows", "faulty", 0),
    ("uncovered obligations", "uncovered", 0), ("matured before the start", "backwards", 0), ("lines without amount", "empty", 0), ("largest balance", "largest", 1_000_000), ("credits not accrued", "credits - accrued", 1000),
]
#: Figures of the dashboard over the same values.
KPIS = [
    ("obligations", "n"), ("ledger lines", "n_lines"), ("principal", "principal"), ("current portion", "current"), ("current share", "current / nullif(principal, 0)"), ("mean balance", "principal / nullif(n, 0)"),
    ("debits", "debits"), ("credits", "credits"), ("accrued interest", "accrued"), ("accrued share", "accrued / nullif(credits, 0)"), ("coverage", "1 - uncovered / nullif(n, 0)"),
]
_OVERVIEW = f"""WITH {LEDGER}, {REGISTER}, l AS (SELECT count(*)::DOUBLE AS n_lines, sum(debit)::DOUBLE - sum(credit)::DOUBLE AS net, sum(amount)::DOUBLE AS lines, sum(debit)::DOUBLE AS debits, sum(credit)::DOUBLE AS credits, coalesce(sum(credit) FILTER (account = 'NO'), 0)::DOUBLE AS accrued, count(*) FILTER (amount = 0)::DOUBLE AS empty FROM ledger),
  r AS (SELECT count(*)::DOUBLE AS n, sum(balance)::DOUBLE AS principal, sum(least(greatest(current, 0), balance))::DOUBLE AS current, sum(current + noncurrent - balance)::DOUBLE AS portions, count(*) FILTER (balance < 0)::DOUBLE AS negative, count({_FAULT})::DOUBLE AS faulty, count(*) FILTER (maturity < start)::DOUBLE AS backwards, max(balance)::DOUBLE AS largest,
    count(*) FILTER (obligation_id NOT IN (SELECT obligation_id FROM ledger))::DOUBLE AS uncovered FROM register), w AS (SELECT * FROM l, r)"""


def _overview(spark, d):
    """One row with all that the dashboard needs: one aggregation of the ledger, one of the register."""
    lines = ledger(spark, d)
    total = lambda c: F.sum(c).cast("double")
    books = lines.agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), (total("debit") - total("credit")).alias("net"), total("amount").alias("lines"), total("debit").alias("debits"), total("credit").alias("credits"),
        criteria.sum_if("credit", F.col("account") == "NO").cast("double").alias("accrued"), F.count_if(F.col("amount") == 0).cast("double").alias("empty"),
    )
    number = lambda c: F.count_if(c).cast("double")
    reg = criteria.attach(register(spark, d), lines, ["obligation_id"], in_ledger=F.count(F.lit(1)))
    fault = classify.register_fault(F.col("balance"), F.col("current"), F.col("noncurrent"))
    debts = reg.agg(
        F.count(F.lit(1)).cast("double").alias("n"), total("balance").alias("principal"), total(classify.clamp(F.col("current"), F.col("balance"))).alias("current"),
        total(F.col("current") + F.col("noncurrent") - F.col("balance")).alias("portions"), number(F.col("balance") < 0).alias("negative"), number(fault.isNotNull()).alias("faulty"),
        number(F.col("maturity") < F.col("start")).alias("backwards"), F.max("balance").cast("double").alias("largest"), number(F.col("in_ledger") == 0).alias("uncovered"),
    )
    return books.crossJoin(debts)  # one row each


@query(_OVERVIEW + " SELECT no_::INT AS no, test, round(value, 2) AS value, " + "CASE WHEN value IS NULL THEN 'pending' WHEN abs(round(value, 2)) <= lim THEN 'OK' ELSE 'DIFERENCIA' END" + " AS verdict FROM (" + " UNION ALL ".join(f"SELECT {i} AS no_, '{t}' AS test, {v} AS value, {lim} AS lim FROM w" for i, (t, v, lim) in enumerate(TESTS, 1)) + ")")
def dashboard_tests(spark, d):
    """The ten tests of the dashboard with their verdicts; counts are held against zero."""
    line = lambda i, t, v, lim: F.struct(F.lit(i).alias("no"), F.lit(t).alias("test"), F.round(F.expr(v), 2).alias("value"), F.lit(float(lim)).alias("lim"))
    rows = _overview(spark, d).select(F.inline(F.array(*[line(i, *t) for i, t in enumerate(TESTS, 1)])))
    verdict = F.when(F.col("value").isNull(), "pending").when(F.abs("value") <= F.col("lim"), "OK").otherwise("DIFERENCIA")
    return rows.select("no", "test", "value", verdict.alias("verdict"))


@query(_OVERVIEW + " SELECT no_::INT AS no, kpi, round(value, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT {i} AS no_, '{k}' AS kpi, {v} AS value FROM w" for i, (k, v) in enumerate(KPIS, 1)) + ")")
def dashboard_kpis(spark, d):
    """The eleven figures of the dashboard."""
    line = lambda i, k, v: F.struct(F.lit(i).alias("no"), F.lit(k).alias("kpi"), F.round(F.expr(v), 6).alias("value"))
    return _overview(spark, d).select(F.inline(F.array(*[line(i, *k) for i, k in enumerate(KPIS, 1)])))


@query(_LINES + """, c AS (SELECT *, power(1 + n, k) * (opening - sum(payment / power(1 + n, k)) OVER (PARTITION BY obligation_id ORDER BY k ROWS UNBOUNDED PRECEDING)) AS close FROM s)
  SELECT obligation_id, k, round(close, 4) AS balance_close, payment FROM c UNION ALL SELECT DISTINCT obligation_id, 0, round(opening, 4), NULL FROM s""")
def lease_with_opening_row(spark, d):
    """Lease schedules with a row before the first payment, which holds the fair value and no flow."""
    from ledgerbeam.functions import schedule

    lines = _lines(spark, d)
    body = schedule.lease_closed_form(lines, "obligation_id", "k", "payment", "opening", "n")
    return schedule.with_opening_row(body, lines, "obligation_id", "k", "opening").select("obligation_id", "k", F.round("balance_close", 4).alias("balance_close"), "payment")


#: Sections of the workpaper: title and what they say, over `_overview`.
SECTIONS = [
    ("1 Existence", "obligations in the register", "n"), ("1 Existence", "obligations that no line covers", "uncovered"), ("2 Completeness", "lines of the ledger", "n_lines"),
    ("2 Completeness", "debits less credits", "net"), ("3 Valuation", "principal", "principal"), ("3 Valuation", "accrued interest", "accrued"), ("4 Classification", "current portion", "current"),
    ("4 Classification", "non-current portion", "principal - current"), ("5 Findings", "faulty rows", "faulty"),
]


@query(_OVERVIEW + " SELECT no_::INT AS no, section, item, round(value, 2) AS amount, (row_number() OVER (PARTITION BY section ORDER BY no_))::INT AS line, count(*) OVER (PARTITION BY section)::BIGINT AS lines FROM (" + " UNION ALL ".join(f"SELECT {i} AS no_, '{s}' AS section, '{t}' AS item, {v} AS value FROM w" for i, (s, t, v) in enumerate(SECTIONS, 1)) + ")")
def workpaper_sections(spark, d):
    """The main workpaper as a table: five sections, their lines and amounts."""
    line = lambda i, s, t, v: F.struct(F.lit(i).alias("no"), F.lit(s).alias("section"), F.lit(t).alias("item"), F.round(F.expr(v), 2).alias("amount"))
    rows = _overview(spark, d).select(F.inline(F.array(*[line(i, *x) for i, x in enumerate(SECTIONS, 1)])))
    own = W.partitionBy("section")
    return rows.select("no", "section", "item", "amount", F.row_number().over(own.orderBy("no")).alias("line"), F.count(F.lit(1)).over(own).alias("lines"))


@query(_LINES + """, c AS (SELECT *, power(1 + n, k) * (opening - sum(payment / power(1 + n, k)) OVER (PARTITION BY obligation_id ORDER BY k ROWS UNBOUNDED PRECEDING)) AS close FROM s),
  d AS (SELECT obligation_id, round((close + payment) / (1 + n) * n - payment * 0.01, 2) AS diff FROM c)
  SELECT obligation_id, count(*)::BIGINT AS n, max(abs(diff)) AS max_abs, count(*) FILTER (abs(diff) > 1000)::BIGINT AS n_over, CASE WHEN max(abs(diff)) <= 1000 THEN 'OK' ELSE 'DIFERENCIA' END AS verdict FROM d GROUP BY 1""")
def schedule_differences(spark, d):
    """Interest recalculated by each schedule against what its lines say, with the largest difference."""
    from ledgerbeam.functions import schedule

    lines = schedule.lease_closed_form(_lines(spark, d), "obligation_id", "k", "payment", "opening", "n")
    diffs = lines.select("obligation_id", F.round(F.col("interest") - F.col("payment") * 0.01, 2).alias("diff"))
    found = diffs.groupBy("obligation_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("diff")).alias("max_abs"), F.count_if(F.abs("diff") > 1000).alias("n_over"))
    return found.select("*", recon.verdict(F.col("max_abs"), PARAMS.trivial).alias("verdict"))


@query(f"""WITH {REGISTER}, {BANKED}, f AS (SELECT bank, {_FAULT} AS fault, balance FROM banked), g AS (SELECT fault, bank, count(*) AS n, sum(balance) AS amount FROM f WHERE fault IS NOT NULL GROUP BY 1, 2),
  i AS (SELECT bank, count(*) AS n, count(*) FILTER (status <> 'F') AS n_open FROM banked WHERE balance > 200000 GROUP BY 1)
  SELECT dense_rank() OVER (ORDER BY fault)::INT AS ref, g.bank, g.n::BIGINT AS n, g.amount::DOUBLE AS amount, coalesce(i.n_open, 0)::BIGINT AS n_open_items, i.n IS NOT NULL AS has_items FROM g LEFT JOIN i ON i.bank = g.bank""")
def finding_links(spark, d):
    """Findings joined by bank with the open items that they wait for: links between results by key, not by cell."""
    items = open_items_summary(spark, d).where("bank is not null and owner is null").select("bank", "n_items", F.col("n_open").alias("n_open_items"))
    found = findings_list(spark, d).select("ref", "bank", "n", "amount").join(items, "bank", "left")
    return found.select("ref", "bank", "n", "amount", F.coalesce("n_open_items", F.lit(0)).alias("n_open_items"), F.col("n_items").isNotNull().alias("has_items"))
