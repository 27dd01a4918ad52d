"""Queries over the ledger: classification, conditional aggregates, lookups, ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerbeam.functions import text
from ledgerbeam.operators import criteria, lookup, ordered, recon, rules
from ledgerbeam.plans.tables import LEDGER, MONEY, PARAMS, REGISTER, ledger, read, register

QUERIES, ORACLES = {}, {}
CUT = f"DATE '{PARAMS.cutoff}'"


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {LEDGER} SELECT obligation_id, line_no, l_partkey, l_suppkey, account, amount::DOUBLE AS amount,
  (debit - credit)::DOUBLE AS net,
  CASE account WHEN 'RF' THEN 'Capital' WHEN 'AF' THEN 'Interest' WHEN 'NO' THEN 'Accrued' ELSE 'Otra' END AS class,
  CASE WHEN credit > 0 AND debit > 0 THEN 'renewal' WHEN credit > 0 THEN 'drawdown' ELSE 'principal payment' END AS movement,
  CASE WHEN account = 'NO' THEN 'NX' ELSE account END AS recoded FROM ledger""")
def enrich_ledger(spark, d):
    """Net, class, movement and recoded account of each ledger line."""
    classes = {"RF": "Capital", "AF": "Interest", "NO": "Accrued"}
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in classes.items() for x in p]), F.col("account")), F.lit("Otra"))
    kind = rules.movement_type(F.col("account"), F.col("debit"), F.col("credit"), F.col("obligation_id").cast("string"))
    return ledger(spark, d).select(
        "obligation_id", "line_no", "l_partkey", "l_suppkey", "account", F.col("amount").cast("double").alias("amount"),
        (F.col("debit") - F.col("credit")).cast("double").alias("net"), label.alias("class"), kind.alias("movement"),
        F.when(F.col("account") == "NO", "NX").otherwise(F.col("account")).alias("recoded"),
    )


PART_RULES = [
    rules.Rule("STEEL", (("p_type", "contains", "STEEL"),)),
    rules.Rule("BRAND-1", (("p_brand", "startswith", "Brand#1"), ("p_type", "regex", "^(SMALL|LARGE)"))),
    rules.Rule("TIN", (("p_type", "endswith", "TIN"),)),
    rules.Rule("PROMO", (("p_type", "regex", "PROMO|ECONOMY"),)),
]


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'STEEL'
  WHEN starts_with(p_brand, 'Brand#1') AND regexp_matches(p_type, '^(SMALL|LARGE)') THEN 'BRAND-1'
  WHEN suffix(p_type, 'TIN') THEN 'TIN' WHEN regexp_matches(p_type, 'PROMO|ECONOMY') THEN 'PROMO' ELSE 'SIN-ID' END AS rule_id FROM part""")
def rule_classify(spark, d):
    """Ordered rules over several columns as one CASE expression."""
    return read(spark, d, "part").select("p_partkey", rules.classify(PART_RULES, "SIN-ID").alias("rule_id"))


TEXT_RULES = [(1, "regex", "[0-9]{3}[-. ][0-9]{4}", "PHONE"), (2, "contains", "License", "LICENSE"), (3, "regex", "(?i)token|secret", "SECRET"), (4, "endswith", "the.", "THE")]


@query("""SELECT doc_id, coalesce((SELECT arg_min(id, priority) FROM (VALUES
  (1, regexp_matches(text, '[0-9]{3}[-. ][0-9]{4}'), 'PHONE'), (2, contains(text, 'License'), 'LICENSE'),
  (3, regexp_matches(text, '(?i)token|secret'), 'SECRET'), (4, suffix(text, 'the.'), 'THE')) r(priority, hit, id) WHERE hit), 'SIN-ID') AS rule_id
  FROM documents""")
def rule_table_classify(spark, d):
    """Rules that come as a table, compiled into one expression: no join of documents with rules."""
    table = spark.createDataFrame(TEXT_RULES, "priority int, kind string, pattern string, result string")
    return read(spark, d, "documents").select("doc_id", rules.classify(rules.rules_from_table(table, "text"), "SIN-ID").alias("rule_id"))


@query("""SELECT o_orderkey, CASE WHEN right(o_orderpriority, 1) = 'H' THEN 'TC' WHEN starts_with(o_orderpriority, '1') THEN
    CASE WHEN o_orderkey % 3 = 0 THEN 'L-0001' ELSE 'SIN-ID' END
  WHEN o_orderstatus = 'F' THEN 'RULE-F' WHEN o_orderkey = 7 THEN 'ROW-7' ELSE 'SIN-ID' END AS opening_id FROM orders""")
def opening_classify(spark, d):
    """Opening lines: card accounts, digits in interest notes, rules, then a row override."""
    note = F.when(F.col("o_orderkey") % 3 == 0, "CRED 0001").otherwise("CRED-9999")
    account = F.when(F.right("o_orderpriority", F.lit(1)) == "H", "2195").when(F.col("o_orderpriority").startswith("1"), "2130").otherwise("2105")
    return read(spark, d, "orders").select("o_orderkey", rules.opening_id(
        note, account, {"0001": "L-0001"}, [rules.Rule("RULE-F", (("o_orderstatus", "equals", "F"),))],
        F.col("o_orderkey").cast("int"), {7: "ROW-7"},
    ).alias("opening_id"))


def _sumifs(spark, d, **wanted):
    return criteria.sumifs(
        register(spark, d).select("obligation_id"), ledger(spark, d), ["obligation_id"], "amount", "total", **wanted
    ).select("obligation_id", F.col("total").cast("double").alias("total"))


def _sumifs_sql(condition: str) -> str:
    return f"""WITH {LEDGER}, s AS (SELECT obligation_id, sum(amount) AS t FROM ledger WHERE {condition} GROUP BY 1)
  SELECT o_orderkey AS obligation_id, coalesce(t, 0)::DOUBLE AS total FROM orders LEFT JOIN s ON obligation_id = o_orderkey"""


@query(_sumifs_sql("account = 'RF'"))
def sumifs_eq(spark, d):
    """Sum by obligation of the lines of one account, 0 where there are none."""
    return _sumifs(spark, d, account="rf")


@query(_sumifs_sql("account = 'NO' AND line_no >= 2 AND line_no < 5"))
def sumifs_multi(spark, d):
    """Several criteria, two of them on one column."""
    return _sumifs(spark, d, account="NO", line_no=[">=2", "<5"])


@query(_sumifs_sql("starts_with(account, 'R')"))
def sumifs_prefix(spark, d):
    return _sumifs(spark, d, account="R*")


@query(_sumifs_sql("contains(account, 'F')"))
def sumifs_infix(spark, d):
    return _sumifs(spark, d, account="*F*")


@query(_sumifs_sql("NOT starts_with(account, 'A')"))
def sumifs_not_prefix(spark, d):
    return _sumifs(spark, d, account="<>A*")


@query(_sumifs_sql("account <> 'RF' AND account IS NOT NULL"))
def sumifs_nonblank(spark, d):
    return _sumifs(spark, d, account=["<>", "<>RF"])


@query(_sumifs_sql(f"entry_date <= {CUT} AND amount > 1000"))
def sumifs_range(spark, d):
    """Bounds on date and amount: the date filter reaches the scan."""
    lines = ledger(spark, d).where(F.col("entry_date") <= F.lit(PARAMS.cutoff))
    return criteria.sumifs(
        register(spark, d).select("obligation_id"), lines, ["obligation_id"], "amount", "total", amount=">1000"
    ).select("obligation_id", F.col("total").cast("double").alias("total"))


@query(f"""WITH {LEDGER}, s AS (SELECT obligation_id, count(*) AS n, count(CASE WHEN debit > 0 THEN 1 END) AS debits FROM ledger GROUP BY 1)
  SELECT o_orderkey AS obligation_id, n IS NOT NULL AS present, CASE WHEN n IS NULL THEN 'absent' WHEN debits = 0 THEN 'zero' ELSE 'some' END AS status,
  coalesce(debits, 0)::BIGINT AS debit_lines FROM orders LEFT JOIN s ON obligation_id = o_orderkey""")
def countif_presence(spark, d):
    """Absent is not zero: obligations without lines against those without debits."""
    spine, debits = register(spark, d).select("obligation_id"), criteria.all_of({"debit": ">0"})
    counted = criteria.attach(spine, ledger(spark, d), ["obligation_id"], n=F.count(F.lit(1)), debit_lines=F.count_if(debits))
    counted = counted.withColumn("present", F.col("n") > 0)
    status = F.when(~F.col("present"), "absent").when(F.col("debit_lines") == 0, "zero").otherwise("some")
    return counted.select("obligation_id", "present", status.alias("status"), "debit_lines")


@query(f"""WITH {LEDGER} SELECT account, count(*)::BIGINT AS n, count(*) FILTER (line_no = 1)::BIGINT AS n_first,
  count(*) FILTER (amount > 50000 AND line_no <> 1)::BIGINT AS n_large_other, count(rate)::BIGINT AS n_rates FROM ledger GROUP BY 1""")
def countifs(spark, d):
    """Several conditional counts in one aggregation."""
    n = lambda **w: F.count_if(criteria.all_of(w))
    return ledger(spark, d).groupBy("account").agg(
        F.count(F.lit(1)).alias("n"), n(line_no=1).alias("n_first"),
        n(amount=">50000", line_no="<>1").alias("n_large_other"), F.count("rate").alias("n_rates"),
    )


@query("""WITH l AS (SELECT user_id, max(ts) AS last_ts FROM events WHERE event_type = 'error' AND value > 10 GROUP BY 1),
  e AS (SELECT user_id, ts, CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE -CAST(value AS DECIMAL(18,2)) END AS a FROM events),
  u AS (SELECT DISTINCT user_id FROM events)
  SELECT u.user_id, l.last_ts IS NOT NULL AS reversed, coalesce((SELECT sum(a) FROM e WHERE e.user_id = u.user_id AND (l.last_ts IS NULL OR e.ts > l.last_ts)), 0)::DOUBLE AS accrued
  FROM u LEFT JOIN l ON l.user_id = u.user_id""")
def maxifs_then_sum_after(spark, d):
    """Accruals strictly after each user's last reversal, all of them where there was none."""
    events = read(spark, d, "events").select("user_id", "ts", "event_type", F.col("value").cast(MONEY).alias("value"))
    signed = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value"))
    found = criteria.max_then_sum_after(
        events.select("user_id").distinct(), events, ["user_id"], "ts",
        (F.col("event_type") == "error") & (F.col("value") > 10), signed, "accrued", "last_ts",
    )
    return found.select("user_id", F.col("last_ts").isNotNull().alias("reversed"), F.col("accrued").cast("double").alias("accrued"))


@query(f"""WITH {LEDGER}, s AS (SELECT obligation_id, max(entry_date) AS m FROM ledger WHERE account = 'RF' GROUP BY 1)
  SELECT o_orderkey AS obligation_id, coalesce(m, DATE '1900-01-01') AS last_date FROM orders LEFT JOIN s ON obligation_id = o_orderkey""")
def maxifs(spark, d):
    """Conditional maximum with the date that stands for none."""
    import datetime as dt

    return criteria.maxifs(register(spark, d).select("obligation_id"), ledger(spark, d), ["obligation_id"], "entry_date", "last_date", dt.date(1900, 1, 1), account="RF")


ORDER = ["entry_date", "line_no", "l_partkey", "l_suppkey", "amount"]
_FIRST = f"""WITH {LEDGER}, f AS (SELECT *, row_number() OVER (PARTITION BY obligation_id ORDER BY entry_date, line_no, l_partkey, l_suppkey, amount) AS rn FROM ledger)"""


@query(_FIRST + "SELECT o_orderkey AS obligation_id, account, l_partkey FROM orders LEFT JOIN f ON obligation_id = o_orderkey AND rn = 1")
def first_match_lookup(spark, d):
    """The first line of each obligation, null where it has none."""
    return lookup.lookup(register(spark, d).select("obligation_id"), ledger(spark, d), ["obligation_id"], ORDER, ["account", "l_partkey"]).select("obligation_id", "account", "l_partkey")


@query(_FIRST + "SELECT o_orderkey AS obligation_id, coalesce(account, 'No está') AS account, rn IS NOT NULL AS matched FROM orders LEFT JOIN f ON obligation_id = o_orderkey AND rn = 1")
def lookup_default(spark, d):
    return lookup.lookup_default(register(spark, d).select("obligation_id"), ledger(spark, d), ["obligation_id"], ORDER, {"account": "No está"}).select("obligation_id", "account", "matched")


@query("SELECT l_orderkey AS obligation_id, l_linenumber AS line_no, o_orderpriority AS rate_type FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def lookup_strict(spark, d):
    """Every line has its order; one without would make the query fail."""
    return lookup.lookup_strict(ledger(spark, d).select("obligation_id", "line_no"), register(spark, d), ["obligation_id"], ["start"], ["rate_type"]).select("obligation_id", "line_no", "rate_type")


@query(f"""WITH {LEDGER}, f AS (SELECT *, row_number() OVER (PARTITION BY obligation_id ORDER BY entry_date DESC, line_no DESC, l_partkey DESC, l_suppkey DESC, amount DESC) AS rn
  FROM ledger WHERE entry_date <= {CUT}) SELECT obligation_id, entry_date, line_no, amount::DOUBLE AS amount FROM f WHERE rn = 1""")
def asof_last_row(spark, d):
    """The last line of each obligation up to the cut-off."""
    return lookup.as_of(ledger(spark, d), ["obligation_id"], "entry_date", PARAMS.cutoff, ORDER[1:]).select("obligation_id", "entry_date", "line_no", F.col("amount").cast("double").alias("amount"))


@query("SELECT o_orderkey AS obligation_id, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_uncovered(spark, d):
    """Obligations that no line covers."""
    return register(spark, d).select("obligation_id", "status").join(ledger(spark, d).select("obligation_id"), "obligation_id", "left_anti")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_filter(spark, d):
    returns = ledger(spark, d).where("account like 'R%'").select(F.col("l_suppkey").alias("s_suppkey"))
    return read(spark, d, "supplier").select("s_suppkey", "s_name").join(returns, "s_suppkey", "left_semi")


@query(f"""WITH {REGISTER}, c AS (SELECT DISTINCT l_orderkey FROM lineitem)
  SELECT sum(balance)::DOUBLE AS total, sum(CASE WHEN l_orderkey IS NULL THEN balance ELSE 0 END)::DOUBLE AS uncovered,
  round(1 - (sum(CASE WHEN l_orderkey IS NULL THEN balance ELSE 0 END)::DOUBLE / nullif(sum(balance), 0)::DOUBLE), 6) AS coverage
  FROM register LEFT JOIN c ON l_orderkey = obligation_id""")
def coverage_ratio(spark, d):
    found = lookup.presence(register(spark, d), ledger(spark, d), ["obligation_id"], "covered")
    sums = found.agg(F.sum("balance").cast("double").alias("total"), criteria.sum_if("balance", ~F.col("covered")).cast("double").alias("uncovered"))
    return sums.select("total", "uncovered", F.round(1 - F.try_divide("uncovered", "total"), 6).alias("coverage"))


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'login' THEN user_id END AS header FROM events)
  SELECT event_id, user_id, last_value(header IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM e""")
def forward_fill(spark, d):
    """Section headers carried down the whole sequence, block by block."""
    events = read(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "login", F.col("user_id")).alias("header"))
    return ordered.forward_fill(events, "event_id", "header", "section", 1000).select("event_id", "user_id", "section")


@query("SELECT event_id, user_id, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS before FROM events")
def lag_default(spark, d):
    before = ordered.lag_default(F.col("value"), F.lit(-1.0), ["user_id"], ["event_id"])
    return read(spark, d, "events").select("event_id", "user_id", before.alias("before"))


@query("""WITH e AS (SELECT *, value > 5 AS ok FROM events), s AS (SELECT user_id, min(event_id) AS a FROM e WHERE ok GROUP BY 1),
  t AS (SELECT e.user_id, min(event_id) AS b FROM e JOIN s ON s.user_id = e.user_id AND event_id >= a WHERE NOT ok GROUP BY 1)
  SELECT e.user_id, event_id FROM e JOIN s ON s.user_id = e.user_id LEFT JOIN t ON t.user_id = e.user_id WHERE event_id >= a AND (b IS NULL OR event_id < b)""")
def take_body(spark, d):
    """From each user's first valid row to the one before the next invalid row."""
    rows = read(spark, d, "events").select("user_id", "event_id", "value")
    return ordered.take_body(rows, ["user_id"], "event_id", F.col("value") > 5, True).select("user_id", "event_id")


@query(r"""WITH g AS (SELECT doc_id, nullif(regexp_extract(text, '([0-9]{1,3}(\.[0-9]{3})+|[0-9]{2,})', 1), '') AS n FROM documents),
  t AS (SELECT doc_id, 'PAGO INTERESES: ' || coalesce(n, 'x') || CASE WHEN doc_id % 3 = 0 THEN '.5' WHEN doc_id % 3 = 1 THEN ',7' ELSE '' END AS d FROM g),
  s AS (SELECT doc_id, nullif(regexp_extract(d, 'INTE?RE?SES?\s*[:$]?\s*([\d][\d\.,]*\d)', 1), '') AS s FROM t)
  SELECT doc_id, CASE WHEN regexp_full_match(s, '\d{1,3}(\.\d{3})+\.\d{1,2}') THEN
      CAST(regexp_replace(left(s, length(s) - length(regexp_extract(s, '\.(\d{1,2})$', 1)) - 1), '\.', '', 'g') || '.' || regexp_extract(s, '\.(\d{1,2})$', 1) AS DOUBLE)
    WHEN regexp_full_match(s, '\d{1,3}(\.\d{3})+|\d+') THEN TRY_CAST(regexp_replace(s, '\.', '', 'g') AS DOUBLE) END AS amount,
  CASE WHEN s IS NULL THEN 'absent' WHEN regexp_full_match(s, '\d{1,3}(\.\d{3})+(\.\d{1,2})?|\d+') THEN 'parsed' ELSE 'unreadable' END AS status FROM s""")
def gloss_amounts(spark, d):
    """Amounts written into free text, with dots for thousands; a gloss is made from each document's first number."""
    number = F.regexp_extract("text", r"([0-9]{1,3}(\.[0-9]{3})+|[0-9]{2,})", 1)
    tail = F.when(F.col("doc_id") % 3 == 0, ".5").when(F.col("doc_id") % 3 == 1, ",7").otherwise("")
    gloss = F.concat(F.lit("PAGO INTERESES: "), F.when(number == "", "x").otherwise(number), tail)
    rows = read(spark, d, "documents").select("doc_id", gloss.alias("gloss"))
    return rows.select("doc_id", text.gloss_amount(F.col("gloss")).alias("amount"), text.gloss_status(F.col("gloss")).alias("status"))


@query("""SELECT c_custkey, CASE WHEN regexp_full_match(k, '[0-9]+') THEN regexp_replace(k, '^0+([0-9])', '\\1') ELSE k END AS number
  FROM (SELECT c_custkey, right(c_name, 6) AS k FROM customer)""")
def key_normalise(spark, d):
    """Register numbers that differ by leading zeros only become the same key."""
    return read(spark, d, "customer").select("c_custkey", lookup.normal_number(F.right("c_name", F.lit(6))).alias("number"))


@query(f"""WITH {LEDGER}, s AS (SELECT obligation_id, line_no, sum(debit) AS dr, sum(credit) AS cr FROM ledger GROUP BY 1, 2),
  b AS (SELECT l_orderkey AS obligation_id, l_linenumber AS line_no, max(CAST(l_quantity AS DECIMAL(18,2))) * 1000 AS bank FROM lineitem GROUP BY 1, 2)
  SELECT obligation_id, line_no, bank::DOUBLE AS bank, (dr + cr)::DOUBLE AS booked, (bank - dr - cr)::DOUBLE AS diff,
  CASE WHEN abs(bank - dr - cr) <= 1000 THEN 'OK' ELSE 'DIFERENCIA' END AS verdict FROM b JOIN s USING (obligation_id, line_no)""")
def payments_vs_vouchers(spark, d):
    """Bank payments against the ledger by document and obligation."""
    bank = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("obligation_id"), F.col("l_linenumber").alias("line_no")).agg((F.max(F.col("l_quantity").cast(MONEY)) * 1000).alias("bank"))
    key = ["obligation_id", "line_no"]
    both = criteria.attach(bank, ledger(spark, d), key, dr=F.sum("debit"), cr=F.sum("credit"))
    diff = F.col("bank") - F.col("dr") - F.col("cr")
    return both.select(*key, F.col("bank").cast("double").alias("bank"), (F.col("dr") + F.col("cr")).cast("double").alias("booked"), diff.cast("double").alias("diff"), recon.verdict(diff, 1000).alias("verdict"))
