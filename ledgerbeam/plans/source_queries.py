"""Queries that read the sources as sheets: rows and cells made of the driver's tables, then scanned and parsed."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerbeam.plans.tables import MONEY, read
from ledgerbeam.schema import LEDGER
from ledgerbeam.sources import readers
from ledgerbeam.sources.workbook import grid

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def dbl(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


@query("""WITH o AS (SELECT *, CAST(o_totalprice AS DECIMAL(20,2)) AS p FROM orders)
  SELECT (o_orderkey + 2)::INT AS src_row, '21' || (o_custkey % 90 + 10) AS account, (CASE WHEN o_orderstatus = 'F' THEN p ELSE -p END)::DOUBLE AS net, o_orderpriority AS description FROM o WHERE o_orderkey % 17 <> 0
  UNION ALL SELECT 1, 'control', (sum(CASE WHEN o_orderstatus = 'F' THEN p ELSE 0 END) - sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE p END))::DOUBLE, NULL FROM o""")
def source_ledger(spark, d):
    """A ledger sheet: its own total in the first row, lines without account left out, texts trimmed."""
    price, debit = F.col("o_totalprice").cast("decimal(20,2)"), F.col("o_orderstatus") == "F"
    made = {
        "src_row": (F.col("o_orderkey") + 2).cast("int"), "debit": F.when(debit, price), "credit": F.when(~debit, price), "entry_date": F.to_date("o_orderdate"),
        "account": F.when(F.col("o_orderkey") % 17 != 0, F.concat(F.lit(" 21"), F.col("o_custkey") % 90 + 10, F.lit("\t"))), "description": F.concat(F.lit(" "), "o_orderpriority", F.lit("\n")),
    }
    lines = read(spark, d, "orders").select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER])
    totals = {"src_row": F.lit(1), "debit": F.sum("debit"), "credit": F.sum("credit")}
    control = lines.agg(*[totals.get(f.name, F.first(F.lit(None))).cast(f.dataType).alias(f.name) for f in LEDGER])
    body, total = readers.ledger_scan(lines.unionByName(control))
    rows = total.select(F.lit(1).alias("src_row"), F.lit("control").alias("account"), *dbl("net"), F.lit(None).cast("string").alias("description"))
    return body.select("src_row", "account", *dbl("net"), "description").unionByName(rows)


@query("""WITH c AS (SELECT *, CAST(c_acctbal AS DECIMAL(20,2)) AS b FROM customer WHERE c_custkey % 10 <> 0)
  SELECT '21' || c_nationkey AS account, arg_max(c_name, c_custkey) AS name, arg_max(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE b END, c_custkey)::DOUBLE AS opening, 10.0::DOUBLE AS debits, 2.5::DOUBLE AS credits, arg_max(b + 7.5, c_custkey)::DOUBLE AS closing, 'v2' AS version FROM c GROUP BY c_nationkey""")
def source_trial_balance(spark, d):
    """A trial balance as text: no-number amounts are 0, totals are no accounts, the last row of an account wins."""
    amount = F.col("c_acctbal").cast("decimal(20,2)")
    rows = read(spark, d, "customer").select(
        F.col("c_custkey").cast("int").alias("src_row"), F.when(F.col("c_custkey") % 10 == 0, "Total").otherwise(F.concat(F.lit(" 21"), "c_nationkey")).alias("c1"), F.col("c_name").alias("c2"),
        F.when(F.col("c_custkey") % 7 == 0, "n/d").otherwise(amount.cast("string")).alias("c3"), F.lit("10").alias("c4"), F.lit("2.5").alias("c5"), (amount + F.lit(7.5).cast("decimal(3,1)")).cast("string").alias("c6"),
    )
    return readers.trial_balance(rows, 1, "v2").select("account", "name", *dbl("opening", "debits", "credits", "closing"), "version")


@query("""WITH c AS (SELECT *, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)
  SELECT (c_nationkey * 10000000 + c_custkey + 1)::INT AS src_row, n_name AS bank, CASE WHEN c_custkey % 9 <> 0 THEN 'obligation' ELSE 'other' END AS row_kind, CASE WHEN c_custkey % 9 <> 0 THEN 'C-' || c_custkey END AS obligation_id FROM c
  UNION ALL SELECT (n_nationkey * 10000000)::INT, n_name, 'bank', NULL FROM nation
  UNION ALL SELECT (n_nationkey * 10000000 + 9999998)::INT, n_name, 'subtotal', NULL FROM nation
  UNION ALL SELECT 250000000, (SELECT n_name FROM nation WHERE n_nationkey = 24), 'total', NULL""")
def source_register(spark, d):
    """A debt register in sections: banks head them, numbers match without leading zeros, a number listed twice counts once."""
    nation, customer = read(spark, d, "nation"), read(spark, d, "customer")
    text, base = F.col("c_custkey").cast("string"), F.col("n_nationkey") * 10_000_000
    row = lambda df, at, label, balance: df.select(at.cast("int").alias("src_row"), label.cast("string").alias("label"), balance.cast(MONEY).alias("balance"))
    sheet = row(customer, F.col("c_nationkey") * 10_000_000 + F.col("c_custkey") + 1, F.lpad(text, 9, "0"), F.col("c_acctbal"))
    sheet = sheet.union(row(nation, base, F.col("n_name"), F.lit(None))).union(row(nation, base + 9_999_998, F.lit(None), F.lit(1)))
    sheet = sheet.union(row(spark.range(1), F.lit(250_000_000), F.lit("TOTAL"), F.lit(1)))
    known = customer.where("c_custkey % 9 <> 0").select(text.alias("number"), F.concat(F.lit("C-"), text).alias("obligation_id"))
    again = customer.where("c_custkey % 9 <> 0 and c_custkey % 2 = 0").select(F.lpad(text, 7, "0").alias("number"), F.concat(F.lit("D-"), text).alias("obligation_id"))
    banks = [r["n_name"] for r in nation.select("n_name").collect()]  # 25 rows
    return readers.register_rows(sheet, banks, known.union(again).union(known)).select("src_row", "bank", "row_kind", "obligation_id")


@query("""WITH r AS (SELECT p_partkey % 12 AS src_row, p_brand AS name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 100.0::DOUBLE END AS rate, p_partkey FROM part WHERE p_size % 7 <> 0)
  SELECT name, round(arg_max(struct_pack(v := rate), (src_row, p_partkey)).v, 6) AS rate FROM r WHERE src_row BETWEEN 2 AND 7 GROUP BY 1""")
def source_rate_map(spark, d):
    """The reference rates at a register's head: a window of rows, the last row of a name, no-number values as null."""
    from ledgerbeam.operators.lookup import last_rows

    value = F.when(F.col("p_size") % 3 == 0, "n/d").otherwise((F.col("p_size") / 100.0).cast("string"))
    rows = read(spark, d, "part").where("p_size % 7 <> 0").select((F.col("p_partkey") % 12).cast("int").alias("src_row"), F.col("p_brand").alias("_b"), value.alias("value"), "p_partkey")
    # one row for each place and name, as on a sheet
    sheet = last_rows(rows, ["src_row", "_b"], ["p_partkey"]).select("src_row", F.concat(F.lit(" "), "_b", F.lit(" ")).alias("label"), "value")
    return readers.rate_map(sheet).select("name", F.round("rate", 6).alias("rate"))


@query("SELECT p_partkey::INT AS src_row, p_brand AS aux_account, p_retailprice AS amount FROM part WHERE p_partkey BETWEEN 68 AND 263 AND p_partkey % 5 <> 0")
def source_opening(spark, d):
    """A prior year's detail: a window of rows, those without an account left out."""
    rows = read(spark, d, "part").select(F.col("p_partkey").cast("int").alias("src_row"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("aux_account"), F.col("p_retailprice").alias("amount"))
    return readers.opening_rows(rows)


@query("SELECT 'S' || s_nationkey AS sheet, s_suppkey::INT AS row, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(CAST(s_acctbal AS DECIMAL(20,2)) AS VARCHAR) END AS balance FROM supplier")
def source_cells(spark, d):
    """Cells as rows of named columns; a cell that is absent is null."""
    at = [F.concat(F.lit("S"), "s_nationkey").alias("sheet"), F.col("s_suppkey").cast("int").alias("row")]
    one = lambda df, n, v: df.select(*at, F.lit(n).alias("col"), v.cast("string").alias("value"))
    rows = read(spark, d, "supplier")
    cells = one(rows, 2, F.col("s_name")).union(one(rows.where("s_suppkey % 3 <> 0"), 5, F.col("s_acctbal").cast("decimal(20,2)"))).union(one(rows, 9, F.lit("x")))
    return grid(cells, {2: "name", 5: "balance"})


def _sheets(spark, d, first, columns, heads):
    """Cells of one sheet for each nation: a line for each customer from row `first` on, and cells at fixed places."""
    order = W.partitionBy("c_nationkey").orderBy("c_custkey")
    lines = read(spark, d, "customer").withColumn("k", F.row_number().over(order)).withColumn("b", F.col("c_acctbal").cast("decimal(20,2)"))
    sheet = F.concat(F.lit("H"), F.col("c_nationkey"))
    cells = lines.select(sheet.alias("sheet"), (F.col("k") + first - 1).cast("int").alias("row"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("col"), v.cast("string").alias("value")) for n, v in columns.items()
    ])))
    fixed = lines.where("k = 1").select(sheet.alias("sheet"), F.inline(F.array(*[
        F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), v.cast("string").alias("value")) for (r, c), v in heads.items()
    ])))
    ids = lines.select(sheet.alias("sheet"), F.concat(F.lit("id-"), F.col("c_nationkey")).alias("id")).distinct()
    return cells.unionByName(fixed), ids


_NUMBERED = """WITH c AS (SELECT *, CAST(c_acctbal AS DECIMAL(20,2)) AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)"""


@query(_NUMBERED + """ SELECT 'id-' || c_nationkey AS id, 'L' AS tipo, (k - 1)::INT AS k, k::DOUBLE AS per, DATE '2020-01-31' + k::INT AS fecha, b::DOUBLE AS saldo_ini, (k % 7)::DOUBLE AS interes, 1.5::DOUBLE AS capital, (k % 7 + 1.5)::DOUBLE AS pago, round(b::DOUBLE - 1.5, 2) AS saldo_fin FROM c WHERE k < 40""")
def source_leases(spark, d):
    """Lease sheets: the body under the last header, up to the first line whose period is no number."""
    k, b, lit = F.col("k"), F.col("b"), F.lit
    stop = F.when(k == 40, "stop").otherwise(k.cast("string"))
    columns = {2: stop, 3: F.date_add(lit("2020-01-31").cast("date"), k), 4: b, 5: k % 7, 6: b - lit("1.5").cast("decimal(3,1)")}
    heads = {(11, 2): lit("Bank"), (12, 2): F.col("c_nationkey"), (14, 2): lit("Plazo "), (14, 3): lit(12), (20, 2): lit("TIR"), (20, 3): lit(0.02), (31, 2): lit("Meses"), (31, 4): lit("Saldo inicial")}
    rows = readers.schedule_rows(readers.lease_tables(*_sheets(spark, d, 32, columns, heads)))
    cents = lambda c: F.round(c, 2).alias(c)
    return rows.select("id", "tipo", "k", "per", "fecha", "saldo_ini", "interes", cents("capital"), cents("pago"), cents("saldo_fin"))


@query(_NUMBERED + """ SELECT 'id-' || c_nationkey AS id, 'C' AS tipo, (k - 3)::INT AS k, k::DOUBLE AS per, CASE WHEN k = 3 THEN 5000.0::DOUBLE ELSE lag(b) OVER (PARTITION BY c_nationkey ORDER BY k)::DOUBLE END AS saldo_ini, (k % 5)::DOUBLE AS interes, 0.0::DOUBLE AS capital, b::DOUBLE AS saldo_fin FROM c WHERE k > 2""")
def source_loans(spark, d):
    """Loan sheets: leading lines that are none are skipped, an opening balance is the closing one before it."""
    k, lit = F.col("k"), F.lit
    columns = {2: F.when(k <= 2, "note").otherwise(k.cast("string")), 6: k % 5, 10: F.col("b")}
    heads = {(4, 3): lit("Bank"), (5, 3): F.col("c_nationkey"), (6, 3): lit(5000), (11, 3): lit(0.1)}
    rows = readers.schedule_rows(readers.loan_tables(*_sheets(spark, d, 26, columns, heads)))
    return rows.select("id", "tipo", "k", "per", "saldo_ini", "interes", "capital", "saldo_fin")
