"""Queries that answer whole sections of a review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerbeam.functions import finance, refs, text
from ledgerbeam.operators import criteria, lookup, recon, rules
from ledgerbeam.plans import report
from ledgerbeam.plans.debt_queries import _LINES, INDEX, _lines, rated
from ledgerbeam.plans.tables import BANKED, LEDGER, MONEY, PARAMS, REGISTER, ledger, read, register, with_bank
from ledgerbeam.sources import sinks

QUERIES, ORACLES = {}, {}
CUT = f"DATE '{PARAMS.cutoff}'"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def dbl(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


@query(f"""WITH {REGISTER}, {BANKED}, a AS (SELECT bank AS label, sum(balance) AS amount FROM banked GROUP BY 1), b AS (SELECT status AS label, sum(balance) AS amount FROM register GROUP BY 1),
  s AS (SELECT 0 AS block, 'By bank' AS title, label, amount, row_number() OVER (ORDER BY label) AS src_row FROM a UNION ALL SELECT 1, 'By status', label, amount, row_number() OVER (ORDER BY label) FROM b)
  SELECT block::INT AS block, title, label, amount::DOUBLE AS amount, src_row::INT AS src_row, (CASE WHEN block = 1 THEN (SELECT count(*) + 3 FROM a) ELSE 0 END + 1 + src_row)::BIGINT AS row_no FROM s""")
def stacked_report(spark, d):
    """Two reports in one table, each row with its block and place."""
    rows = with_bank(register(spark, d), spark, d)
    side = lambda c: rows.groupBy(F.col(c).alias("label")).agg(F.sum("balance").alias("amount"))
    found = report.stack([("By bank", side("bank"), ["label"]), ("By status", side("status"), ["label"])])
    return found.select("block", "title", "label", *dbl("amount"), "src_row", "row_no")


@query(f"""WITH {LEDGER}, {REGISTER}, t AS (SELECT (SELECT sum(debit) - sum(credit) FROM ledger)::DOUBLE AS net, (SELECT count(*) FROM register WHERE obligation_id NOT IN (SELECT obligation_id FROM ledger))::DOUBLE AS uncovered,
    (SELECT sum(current + noncurrent - balance) FROM register)::DOUBLE AS portions, (SELECT count(*) FROM register WHERE balance < 0)::DOUBLE AS negative, (SELECT max(balance) FROM register)::DOUBLE AS largest)
  SELECT no::INT AS no, test, value, CASE WHEN value IS NULL THEN 'pending' WHEN abs(value) <= lim THEN 'OK' ELSE 'DIFERENCIA' END AS verdict FROM (
    SELECT 1 AS no, 'net movement' AS test, net AS value, 1000 AS lim FROM t UNION ALL SELECT 2, 'uncovered obligations', uncovered, 0 FROM t UNION ALL SELECT 3, 'portions against balance', portions, 1000 FROM t
    UNION ALL SELECT 4, 'negative balances', negative, 0 FROM t UNION ALL SELECT 5, 'largest balance', largest, 1000000 FROM t)""")
def dashboard(spark, d):
    """Tests with their values and verdicts. Counts are held against zero, not against the money threshold."""
    lines, reg = ledger(spark, d), register(spark, d)
    uncovered = reg.join(lines.select("obligation_id"), "obligation_id", "left_anti")
    count = lambda df: df.agg(F.count(F.lit(1)).alias("value"))
    return report.dashboard([
        ("net movement", lines.agg((F.sum("debit") - F.sum("credit")).alias("value")), PARAMS.trivial),
        ("uncovered obligations", count(uncovered), 0),
        ("portions against balance", reg.agg(F.sum(F.col("current") + F.col("noncurrent") - F.col("balance")).alias("value")), PARAMS.trivial),
        ("negative balances", count(reg.where("balance < 0")), 0),
        ("largest balance", reg.agg(F.max("balance").alias("value")), 1_000_000),
    ])


@query(f"""WITH {LEDGER}, {REGISTER}, s AS (SELECT obligation_id, sum(credit) FILTER (account = 'NO') AS accrued, sum(credit) AS credits, sum(debit) AS debits FROM ledger GROUP BY 1)
  SELECT r.obligation_id, CASE WHEN contains(rate_type, 'H') THEN 'lease' ELSE 'credit' END AS kind, coalesce(accrued, 0)::DOUBLE AS accrued, (coalesce(credits, 0) - coalesce(accrued, 0))::DOUBLE AS other_credits, coalesce(debits, 0)::DOUBLE AS paid,
    (coalesce(credits, 0) - coalesce(debits, 0))::DOUBLE AS net FROM register r LEFT JOIN s ON s.obligation_id = r.obligation_id""")
def interest_by_obligation(spark, d):
    """Accrued, other and paid interest of each obligation, in one aggregation of the ledger."""
    lease = F.when(F.col("rate_type").contains("H"), F.concat(F.lit("X-L"), F.col("obligation_id"))).otherwise(F.concat(F.lit("X-"), F.col("obligation_id")))
    spine = register(spark, d).select("obligation_id", rules.obligation_kind(lease).alias("kind"))
    found = criteria.attach(spine, ledger(spark, d), ["obligation_id"], accrued=F.sum(F.when(F.col("account") == "NO", F.col("credit"))), credits=F.sum("credit"), paid=F.sum("debit"))
    found = found.withColumn("other_credits", F.col("credits") - F.col("accrued")).withColumn("net", F.col("credits") - F.col("paid"))
    return found.select("obligation_id", "kind", *dbl("accrued", "other_credits", "paid", "net"))


@query(f"""WITH {REGISTER}, c AS (SELECT obligation_id, CASE WHEN obligation_id % 5 <> 0 THEN balance + (obligation_id % 3) * 600 END AS principal, (obligation_id % 4 * 100)::DECIMAL(18,2) AS later, CASE WHEN obligation_id % 6 = 0 THEN NULL ELSE maturity + (obligation_id % 2)::INT END AS cert_maturity
    FROM register WHERE status = 'F')
  SELECT r.obligation_id, (principal - later)::DOUBLE AS adjusted, (principal - later - balance)::DOUBLE AS diff, CASE WHEN cert_maturity IS NULL THEN 'N/D' WHEN cert_maturity = maturity THEN 'Sí' ELSE 'NO' END AS maturity_agrees,
    CASE WHEN principal IS NULL THEN NULL WHEN abs(principal - later - balance) <= 1000 THEN 'OK' ELSE 'DIFERENCIA' END AS verdict FROM c JOIN register r ON r.obligation_id = c.obligation_id""")
def certificates_vs_register(spark, d):
    """Certificates less later repayments against the register; what isn't certified stays null."""
    key = F.col("obligation_id")
    certs = register(spark, d).where("status = 'F'").select(
        "obligation_id", F.when(key % 5 != 0, F.col("balance") + (key % 3) * 600).alias("principal"), (key % 4 * 100).cast(MONEY).alias("later"),
        F.when(key % 6 != 0, F.date_add("maturity", (key % 2).cast("int"))).alias("cert_maturity"),
    )
    both = lookup.lookup(certs, register(spark, d), ["obligation_id"], ["start"], ["balance", "maturity"])
    adjusted = F.col("principal") - F.col("later")
    agrees = F.when(F.col("cert_maturity").isNull(), "N/D").when(F.col("cert_maturity") == F.col("maturity"), "Sí").otherwise("NO")
    diff = adjusted - F.col("balance")
    return both.select("obligation_id", adjusted.cast("double").alias("adjusted"), diff.cast("double").alias("diff"), agrees.alias("maturity_agrees"), recon.worst_verdict(PARAMS.trivial, diff).alias("verdict"))


@query(f"""WITH {REGISTER}, {BANKED}, u AS (SELECT bank, obligation_id, balance, status <> 'F' AS uncertified FROM banked)
  SELECT bank, count(*) FILTER (uncertified)::BIGINT AS n_uncertified, coalesce(sum(balance) FILTER (uncertified), 0)::DOUBLE AS uncertified, round(1 - coalesce(sum(balance) FILTER (uncertified), 0)::DOUBLE / nullif(sum(balance), 0)::DOUBLE, 6) AS coverage FROM u GROUP BY ROLLUP (bank)""")
def uncertified_coverage(spark, d):
    """What no certificate with a balance covers, for each bank and in all."""
    rows = with_bank(register(spark, d), spark, d).withColumn("open", F.col("status") != "F")
    found = rows.rollup("bank").agg(F.count_if("open").alias("n_uncertified"), criteria.sum_if("balance", F.col("open")).cast("double").alias("uncertified"), F.sum("balance").cast("double").alias("w"))
    return found.select("bank", "n_uncertified", "uncertified", F.round(1 - F.try_divide("uncertified", "w"), 6).alias("coverage"))


@query(f"""WITH {LEDGER}, {REGISTER} SELECT l.obligation_id, l.line_no, l.l_partkey, l.l_suppkey, left(account, 1) AS prefix, l.amount::DOUBLE AS amount FROM ledger l
  WHERE left(account, 1) IN ('A', 'N') AND account <> 'NO' AND obligation_id IN (SELECT obligation_id FROM register WHERE status = 'F')""")
def gloss_filter(spark, d):
    """Lines of some account groups, one account aside, of obligations in a set."""
    wanted = ledger(spark, d).where(F.substring("account", 1, 1).isin("A", "N") & (F.col("account") != "NO"))
    return wanted.join(register(spark, d).where("status = 'F'").select("obligation_id"), "obligation_id", "left_semi").select(
        "obligation_id", "line_no", "l_partkey", "l_suppkey", F.substring("account", 1, 1).alias("prefix"), *dbl("amount")
    )


@query(f"""WITH {REGISTER}, {BANKED}, s AS (SELECT bank, count(*) AS n, sum(balance) AS b, sum(CASE WHEN status = 'F' THEN balance ELSE 0 END) AS f FROM banked GROUP BY 1)
  SELECT bank, bank || ': ' || n || ' obligations, $' || format('{{:,}}', CAST(round(b, 0) AS BIGINT)) || ', ' || CAST(round(f::DOUBLE / b::DOUBLE * 100, 0) AS BIGINT) || '% finished' AS sentence FROM s""")
def narrative(spark, d):
    """A sentence for each bank, with its numbers."""
    sums = with_bank(register(spark, d), spark, d).groupBy("bank").agg(F.count(F.lit(1)).alias("n"), F.sum("balance").alias("b"), criteria.sum_if("balance", F.col("status") == "F").alias("f"))
    share = F.col("f").cast("double") / F.col("b").cast("double")
    return sums.select("bank", F.concat("bank", F.lit(": "), "n", F.lit(" obligations, "), text.amount_text(F.col("b"), "$"), F.lit(", "), text.percent_text(share), F.lit(" finished")).alias("sentence"))


@query("""SELECT p_partkey, replace(replace(replace(p_type, 'STEEL', 'TIN'), 'TIN', 'IRON'), 'PROMO', 'SALE') AS label, CASE WHEN p_brand = '' THEN p_name ELSE p_brand || ' – ' || p_name END AS title FROM part""")
def label_rewrite(spark, d):
    """Replacements in order, each on the result of the one before."""
    label = text.replace_labels(F.col("p_type"), [("STEEL", "TIN"), ("TIN", "IRON"), ("PROMO", "SALE")])
    return read(spark, d, "part").select("p_partkey", label.alias("label"), text.label(F.when(F.col("p_brand") != "", F.col("p_brand")), F.col("p_name")).alias("title"))


@query(f"""WITH {LEDGER}, {REGISTER}, x AS (SELECT r.obligation_id, status, CASE status WHEN 'F' THEN 'certificate' WHEN 'O' THEN 'register' ELSE 'ledger' END AS capital_source,
    CASE status WHEN 'F' THEN balance + 1 WHEN 'O' THEN balance ELSE coalesce((SELECT sum(credit) - sum(debit) FROM ledger l WHERE l.obligation_id = r.obligation_id), 0) END AS capital, {INDEX} AS ea, datediff('day', start, maturity) AS days FROM register r)
  SELECT obligation_id, capital_source, capital::DOUBLE AS capital, CASE WHEN days = 0 THEN 0 ELSE round(capital::DOUBLE * (power(1 + ea, days / 365.0) - 1), 2) END AS accrued FROM x""")
def cutoff_accrual(spark, d):
    """Accrued interest on a principal whose source is chosen, and named, for each row."""
    spine = rated(spark, d)
    found = criteria.attach(spine, ledger(spark, d), ["obligation_id"], cr=F.sum("credit"), dr=F.sum("debit"))
    source = F.when(F.col("status") == "F", "certificate").when(F.col("status") == "O", "register").otherwise("ledger")
    capital = F.when(F.col("status") == "F", F.col("balance") + 1).when(F.col("status") == "O", F.col("balance")).otherwise(F.col("cr") - F.col("dr"))
    rows = found.select("obligation_id", source.alias("capital_source"), capital.cast("double").alias("capital"), "idx", F.datediff("maturity", "start").alias("days"))
    return rows.select("obligation_id", "capital_source", "capital", F.round(finance.compound_interest(F.col("capital"), F.col("idx"), F.col("days")), 2).alias("accrued"))


@query(_LINES + f""", l AS (SELECT obligation_id, count(*) AS n, max(k) FILTER (entry_date <= {CUT}) AS k FROM s GROUP BY 1)
  SELECT l.obligation_id AS id, l.n::BIGINT AS n_rows, s.k::DOUBLE AS last_period, s.payment AS balance FROM l LEFT JOIN s ON s.obligation_id = l.obligation_id AND s.k = l.k""")
def schedule_summary(spark, d):
    """Rows of each schedule, and its last one up to the cut-off."""
    rows = _lines(spark, d).select(F.col("obligation_id").alias("id"), "k", F.col("k").cast("double").alias("per"), F.col("entry_date").alias("fecha"), F.col("payment").alias("saldo_fin"))
    return sinks.schedule_summary(rows, PARAMS.cutoff)


@query(_LINES + """ SELECT obligation_id AS id, CAST(to_json(struct_pack(filas := list(struct_pack(k := k, fecha := CAST(entry_date AS VARCHAR), pago := payment) ORDER BY k))) AS VARCHAR) AS json FROM s GROUP BY 1""")
def schedule_json(spark, d):
    """Each order's schedule as one JSON document."""
    lines = _lines(spark, d).groupBy(F.col("obligation_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("k", F.col("entry_date").alias("fecha"), F.col("payment").alias("pago")))).alias("filas")
    )
    return sinks.schedules_json(lines)


@query("""WITH c AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'Ledger' ELSE 'Main' END AS src_sheet, l_partkey::INT AS k, l_linenumber::INT AS col FROM lineitem)
  SELECT CASE WHEN src_sheet = 'Ledger' THEN 'Report' ELSE src_sheet END AS sheet, (CASE WHEN src_sheet = 'Ledger' THEN k + 10 ELSE k END)::INT AS row, col, src_sheet, k AS src_row, src_sheet = 'Ledger' AS is_calculated,
    CASE WHEN src_sheet = 'Ledger' THEN '=SUMIFS($J$6001:$J$9000,A' || (k + 10) || ',"Ledger!A1")+B$' || (k + 10) || '*''Rates 2026''!C4'
    ELSE '=SUMIFS(Report!$J$6001:$J$9000,Report!A' || (k + 10) || ',"Ledger!A1")+B$' || k || '*''Rates 2026''!C4' END AS value FROM c""")
def a1_translate(spark, d):
    """Formulas over two sheets, made from the lines, moved onto one stacked sheet."""
    moves = {"Ledger": refs.Move("Report", 10, 11, 5000), "Detail 62": refs.Move("Report", 6000, 6001, 9000)}
    lines = ledger(spark, d).select("obligation_id", "line_no", "l_partkey")
    key = F.col("l_partkey").cast("string")
    value = F.concat(F.lit("=SUMIFS('Detail 62'!$J:$J,Ledger!A"), key, F.lit(',"Ledger!A1")+B$'), key, F.lit("*Rates!C4"))
    sheet = F.when(F.col("line_no") % 2 == 0, "Ledger").otherwise("Main")
    cells = lines.select(sheet.alias("sheet"), F.col("l_partkey").cast("int").alias("row"), F.col("line_no").cast("int").alias("col"), value.alias("value"))
    return refs.translate_cells(cells, moves, {"Rates": "Rates 2026"})
