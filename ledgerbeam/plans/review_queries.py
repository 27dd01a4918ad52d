"""Queries that join several results of a review: schedules, documents, reclassifications, windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerbeam.functions import finance
from ledgerbeam.operators import classify, criteria, lookup, recon
from ledgerbeam.plans.debt_queries import _LINES, INDEX, _lines, rated
from ledgerbeam.plans.tables import BANKED, LEDGER, MONEY, PARAMS, REGISTER, ledger, read, register, with_bank
from ledgerbeam.streaming.tieout import windowed_sums

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


@query(_LINES + " SELECT obligation_id, payment, entry_date FROM s WHERE k = 5")
def nth_row_pick(spark, d):
    """The fifth line of each schedule."""
    return _lines(spark, d).where("k = 5").select("obligation_id", "payment", "entry_date")


@query(_LINES + f""", l AS (SELECT obligation_id, max(k) AS k FROM s WHERE entry_date <= {CUT} GROUP BY 1), o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS ca FROM orders)
  SELECT l.obligation_id, (ca - CAST(payment AS DECIMAL(18,2)))::DOUBLE AS diff, abs(ca - CAST(payment AS DECIMAL(18,2))) > 1000 AS alarm
  FROM l JOIN s ON s.obligation_id = l.obligation_id AND s.k = l.k JOIN o ON o_orderkey = l.obligation_id""")
def cost_basis_alarm(spark, d):
    """Amortized cost against the balance in the last line up to the cut-off."""
    last = lookup.as_of(_lines(spark, d).select("obligation_id", "entry_date", "k", "payment", "opening"), ["obligation_id"], "entry_date", PARAMS.cutoff, ["k"])
    diff = F.col("opening").cast(MONEY) - F.col("payment").cast(MONEY)
    return last.select("obligation_id", diff.cast("double").alias("diff"), (F.abs(diff) > 1000).alias("alarm"))


@query("""WITH a AS (SELECT s_nationkey AS k, max(s_name) AS v FROM supplier GROUP BY 1), b AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey < 3)
  SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k""")
def map_union(spark, d):
    """Two maps as one, the right one's entries winning."""
    a = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("v"))
    b = read(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)))
    return lookup.last_rows(both, ["k"], ["side"]).select("k", "v")


@query(f"""WITH {LEDGER}, {REGISTER}, p AS (SELECT obligation_id, sum(debit) AS paid, max(entry_date) FILTER (debit > 0) AS last_paid FROM ledger GROUP BY 1)
  SELECT r.obligation_id, (balance - current)::DOUBLE AS document_principal, coalesce(paid, 0)::DOUBLE AS paid, last_paid, CASE WHEN last_paid IS NULL THEN 'N/D' WHEN last_paid <= maturity THEN 'Sí' ELSE 'NO' END AS in_time,
  (balance - current - coalesce(paid, 0))::DOUBLE AS diff FROM register r LEFT JOIN p ON p.obligation_id = r.obligation_id WHERE status = 'P'""")
def bank_documents(spark, d):
    """Documents of the bank filled in from payments that are known only later."""
    spine = register(spark, d).where("status = 'P'").select("obligation_id", "maturity", (F.col("balance") - F.col("current")).alias("document_principal"))
    paid = criteria.attach(spine, ledger(spark, d), ["obligation_id"], paid=F.sum("debit"), last_paid=F.max(F.when(F.col("debit") > 0, F.col("entry_date"))))
    in_time = F.when(F.col("last_paid").isNull(), "N/D").when(F.col("last_paid") <= F.col("maturity"), "Sí").otherwise("NO")
    return paid.withColumn("diff", F.col("document_principal") - F.col("paid")).select("obligation_id", *dbl("document_principal", "paid"), "last_paid", in_time.alias("in_time"), *dbl("diff"))


@query(_LINES.replace("WITH ledger", f"WITH {REGISTER}, ledger") + f""", a AS (SELECT obligation_id, count(*) AS n, max(k) AS last_k, sum(CAST(payment AS DECIMAL(18,2))) AS capital FROM s GROUP BY 1)
  SELECT r.obligation_id, CASE WHEN n IS NULL THEN 'Sin tabla' ELSE 'tabla' END AS status, coalesce(n, 0)::BIGINT AS n_rows, (capital - balance)::DOUBLE AS diff, round(({INDEX} - spread) * 10000, 4) AS basis_points
  FROM register r LEFT JOIN a ON a.obligation_id = r.obligation_id WHERE rate_type NOT LIKE '5%'""")
def schedule_review(spark, d):
    """The register against the schedules: what has none stays null and says so; one rate type is left out."""
    rows = _lines(spark, d).groupBy("obligation_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("payment").cast(MONEY)).alias("capital"))
    spine = rated(spark, d).where(criteria.criterion(F.col("rate_type"), "<>5*"))
    found = spine.join(rows, "obligation_id", "left")
    status = F.when(F.col("n_rows").isNull(), "Sin tabla").otherwise("tabla")
    return found.select(
        "obligation_id", status.alias("status"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (F.col("capital") - F.col("balance")).cast("double").alias("diff"),
        F.round(finance.basis_points(F.col("idx"), F.col("spread")), 4).alias("basis_points"),
    )


@query(f"""WITH {REGISTER}, {BANKED} SELECT sum(balance) FILTER (bank NOT LIKE 'A%' AND status <> 'P')::DOUBLE AS kept, sum(balance) FILTER (obligation_id IN (SELECT l_orderkey FROM lineitem))::DOUBLE AS covered, count(DISTINCT bank)::BIGINT AS banks FROM banked""")
def filtered_total(spark, d):
    """Totals that leave out some rows on purpose."""
    rows = lookup.presence(with_bank(register(spark, d), spark, d), ledger(spark, d), ["obligation_id"], "in_ledger")
    keep = criteria.all_of({"bank": "<>A*", "status": "<>P"})
    return rows.agg(criteria.sum_if("balance", keep).cast("double").alias("kept"), criteria.sum_if("balance", F.col("in_ledger")).cast("double").alias("covered"), F.count_distinct("bank").alias("banks"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, (CAST(o_orderdate AS DATE) - CAST(date_trunc('year', o_orderdate) AS DATE))::INT AS day_of_year,
  CAST(strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS back, upper(left(o_orderpriority, 1)) || lower(substr(o_orderpriority, 2)) AS title FROM orders""")
def iso_dates(spark, d):
    """Dates to ISO text and back, and day differences."""
    date = F.to_date("o_orderdate")
    iso = F.date_format(date, "yyyy-MM-dd")
    title = F.concat(F.upper(F.left("o_orderpriority", F.lit(1))), F.lower(F.substr("o_orderpriority", F.lit(2))))
    return read(spark, d, "orders").select("o_orderkey", iso.alias("iso"), F.datediff(date, F.trunc(date, "year")).alias("day_of_year"), F.to_date(iso).alias("back"), title.alias("title"))


@query(f"""WITH {REGISTER}, x AS (SELECT status, sum(CASE WHEN maturity <= {NEXT} THEN balance ELSE least(greatest(current, 0), balance) END) AS should, sum(current) AS booked FROM register GROUP BY 1)
  SELECT status, 'current' AS account, greatest(should - booked, 0)::DOUBLE AS debit, greatest(booked - should, 0)::DOUBLE AS credit FROM x UNION ALL
  SELECT status, 'noncurrent', greatest(booked - should, 0)::DOUBLE, greatest(should - booked, 0)::DOUBLE FROM x""")
def reclass_entries(spark, d):
    """Entries that move balances between current and non-current, debits equal to credits."""
    portion = classify.current_portion(F.col("balance"), F.col("maturity"), F.lit(None).cast(MONEY), F.col("current"), PARAMS.next_year)
    sums = register(spark, d).groupBy("status").agg(F.sum(portion["amount"]).alias("should"), F.sum("current").alias("booked"))
    up, down = (F.greatest(a - b, F.lit(0)).cast("double") for a, b in ((F.col("should"), F.col("booked")), (F.col("booked"), F.col("should"))))
    line = lambda account, debit, credit: F.struct(F.lit(account).alias("account"), debit.alias("debit"), credit.alias("credit"))
    return sums.select("status", F.inline(F.array(line("current", up, down), line("noncurrent", down, up))))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n, sum(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END)::DOUBLE AS debits,
  sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END)::DOUBLE AS credits FROM events GROUP BY 1, 2""")
def windowed_tie_out(spark, d):
    """The stream's daily sums, run over the whole table at once."""
    rows = read(spark, d, "events").select("ts", "event_type", F.col("value").cast(MONEY).alias("value"))
    return windowed_sums(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", *dbl("debits", "credits"))


@query(f"""WITH {LEDGER}, s AS (SELECT account, entry_date, sum(debit) AS d, sum(credit) AS c FROM ledger GROUP BY 1, 2)
  SELECT account, entry_date, row_number() OVER (PARTITION BY account ORDER BY entry_date)::INT AS no, sum(d - c) OVER (PARTITION BY account ORDER BY entry_date ROWS UNBOUNDED PRECEDING)::DOUBLE AS running FROM s""")
def running_balance(spark, d):
    """Daily movements of each account, numbered and accumulated: aggregated first, so the window is short."""
    days = ledger(spark, d).groupBy("account", "entry_date").agg(F.sum(F.col("debit") - F.col("credit")).alias("m"))
    order = W.partitionBy("account").orderBy("entry_date")
    return days.select("account", "entry_date", F.row_number().over(order).alias("no"), F.sum("m").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("double").alias("running"))


@query(f"""WITH {REGISTER}, o AS (SELECT *, CASE WHEN obligation_id % 13 = 0 THEN DATE '1999-12-31' END AS own FROM register)
  SELECT obligation_id, coalesce(own, maturity) AS maturity, coalesce(own, maturity) <= {NEXT} AS soon, CASE WHEN abs(balance - current) <= 1000 THEN 'OK' ELSE 'DIFERENCIA' END AS verdict FROM o""")
def maturity_override(spark, d):
    """A maturity known otherwise goes before the register's."""
    own = F.when(F.col("obligation_id") % 13 == 0, F.lit("1999-12-31").cast("date"))
    due = classify.maturity(own, F.col("maturity"))
    return register(spark, d).select("obligation_id", due.alias("maturity"), (due <= F.lit(PARAMS.next_year)).alias("soon"), recon.verdict(F.col("balance") - F.col("current"), PARAMS.trivial).alias("verdict"))
