"""Queries whose hot keys, long chains and large rule tables are spread over tasks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerbeam.functions import schedule
from ledgerbeam.operators import hierarchy, links, ranges, rule_index
from ledgerbeam.plans.tables import LEDGER, MONEY, REGISTER, ledger, read, register

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {REGISTER} SELECT o.obligation_id, (SELECT coalesce(sum(f.balance), 0) FROM register f WHERE f.custkey = o.custkey AND f.start > o.start AND f.start <= o.maturity)::DOUBLE AS drawn_later FROM register o""")
def range_sums_many_periods(spark, d):
    """What each obligation's customer draws after its start and up to its maturity: many periods for one customer."""
    rows = register(spark, d)
    spine = rows.select("obligation_id", "custkey", F.col("start").alias("low"), "maturity")
    out = ranges.sums_between(spine, rows.select("custkey", "start", "balance"), ["custkey"], "start", "low", "maturity", "balance", "drawn_later", with_low=False)
    return out.select("obligation_id", F.col("drawn_later").cast("double").alias("drawn_later"))


@query(f"""WITH {LEDGER}, {REGISTER}, f AS (SELECT account, entry_date, sum(amount) AS v FROM ledger GROUP BY 1, 2),
  s AS (SELECT obligation_id, CASE obligation_id % 4 WHEN 0 THEN 'AF' WHEN 1 THEN 'RF' ELSE 'NO' END AS account, CASE WHEN obligation_id % 7 <> 0 THEN start END AS low,
    CASE WHEN obligation_id % 11 <> 0 THEN maturity - 300 END AS high FROM register)
  SELECT obligation_id, coalesce(t, 0)::DOUBLE AS total FROM s LEFT JOIN (SELECT obligation_id AS o, sum(v) AS t FROM s JOIN f ON f.account = s.account
    AND (low IS NULL OR entry_date >= low) AND (high IS NULL OR entry_date <= high) GROUP BY 1) ON o = obligation_id""")
def range_sums_hot_key(spark, d):
    """Ledger amounts of three accounts between two dates of each obligation, some of them open and some turned round."""
    account = F.when(F.col("obligation_id") % 4 == 0, "AF").when(F.col("obligation_id") % 4 == 1, "RF").otherwise("NO")
    spine = register(spark, d).select(
        "obligation_id", account.alias("account"), F.when(F.col("obligation_id") % 7 != 0, F.col("start")).alias("low"),
        F.when(F.col("obligation_id") % 11 != 0, F.date_sub("maturity", 300)).alias("high"),
    )
    out = ranges.sums_between(spine, ledger(spark, d).select("account", "entry_date", "amount"), ["account"], "entry_date", "low", "high", "amount", "total")
    return out.select("obligation_id", F.col("total").cast("double").alias("total"))


_LONG = f"""WITH RECURSIVE {LEDGER}, s AS (SELECT l_suppkey, amount::DOUBLE / 997 AS payment, rate / 100 AS rate,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY entry_date, obligation_id, line_no, l_partkey, amount) AS k FROM ledger)"""


@query(_LONG + """, r AS (SELECT l_suppkey, k, 100000 * rate AS i, 100000 + 100000 * rate - payment AS j FROM s WHERE k = 1
  UNION ALL SELECT s.l_suppkey, s.k, r.j * s.rate, r.j + r.j * s.rate - s.payment FROM r JOIN s ON s.l_suppkey = r.l_suppkey AND s.k = r.k + 1)
  SELECT l_suppkey, k, round(j, 3) AS balance_close, CASE WHEN round(i, 3) = 0 THEN 0 ELSE round(i, 3) END AS interest FROM r""")
def schedule_recurrence_scan(spark, d):
    """One long schedule for each supplier, with rates that change: blocks of periods compose as affine maps."""
    order = W.partitionBy("l_suppkey").orderBy("entry_date", "obligation_id", "line_no", "l_partkey", "amount")
    rows = ledger(spark, d).select(
        "l_suppkey", (F.col("amount").cast("double") / 997).alias("payment"), (F.col("rate") / 100).alias("rate"), F.lit(100000.0).alias("opening"),
        F.row_number().over(order).alias("k"),
    )
    found = schedule.recurrence_scan(rows, "l_suppkey", "k", "payment", "opening", "rate", span=64)
    return found.select("l_suppkey", "k", F.round("balance_close", 3).alias("balance_close"), F.round("interest", 3).alias("interest"))


@query("""WITH RECURSIVE e AS (SELECT 'R' || r_regionkey AS child, 'ALL' AS parent, 0::DECIMAL(18,2) AS v FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 0 FROM nation
    UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) FROM customer UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) FROM orders
    UNION ALL SELECT 'ALL', NULL, 0),
  up AS (SELECT child AS node, child AS anc, v, 0 AS steps FROM e UNION ALL SELECT node, e.parent, up.v, steps + 1 FROM up JOIN e ON e.child = up.anc WHERE e.parent IS NOT NULL),
  depths AS (SELECT node, max(steps) AS depth FROM up GROUP BY 1)
  SELECT anc AS node, sum(v)::DOUBLE AS total, any_value(depth)::BIGINT AS depth, 'ok' AS state FROM up JOIN depths ON depths.node = anc GROUP BY 1""")
def hierarchy_roll_up(spark, d):
    """Balances of orders and customers summed to every level above them."""
    level = lambda name, letter, key, up, above, v: read(spark, d, name).select(
        F.concat(F.lit(letter), key).alias("node"), F.concat(F.lit(above), up).alias("parent"), v.cast(MONEY).alias("v")
    )
    none = F.lit(0)
    rows = (
        level("region", "R", "r_regionkey", F.lit(""), "ALL", none).union(level("nation", "N", "n_nationkey", "n_regionkey", "R", none))
        .union(level("customer", "C", "c_custkey", "c_nationkey", "N", F.col("c_acctbal"))).union(level("orders", "O", "o_orderkey", "o_custkey", "C", F.col("o_totalprice")))
    )
    top = read(spark, d, "region").groupBy().agg(F.lit("ALL").alias("node"), F.max(F.lit(0)).cast(MONEY).alias("v"))
    found = hierarchy.roll_up(rows.select("node", "v").union(top), rows.select("parent", F.col("node").alias("child")), "node", "v")
    return found.select("node", F.col("total").cast("double").alias("total"), "depth", "state")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS node, p_size AS v, CASE WHEN p_partkey % 97 = 1 AND p_partkey > 1 THEN 2 * p_partkey WHEN p_partkey % 31 = 0 THEN -p_partkey WHEN p_partkey > 1 THEN p_partkey // 2 END AS up FROM part),
  e AS (SELECT a.node, a.v, b.node AS up, a.up IS NOT NULL AND b.node IS NULL AS orphan FROM p a LEFT JOIN p b ON b.node = a.up),
  reach AS (SELECT node, up AS anc FROM e WHERE up IS NOT NULL UNION SELECT reach.node, e.up FROM reach JOIN e ON e.node = reach.anc WHERE e.up IS NOT NULL),
  turning AS (SELECT node FROM reach WHERE node = anc), below AS (SELECT DISTINCT node FROM reach WHERE anc IN (SELECT node FROM turning)),
  sums AS (SELECT anc, sum(v) AS v FROM reach JOIN e ON e.node = reach.node GROUP BY 1), depths AS (SELECT node, count(*) AS depth FROM reach GROUP BY 1)
  SELECT e.node::BIGINT AS node, CASE WHEN e.node NOT IN (SELECT node FROM turning) THEN e.v + coalesce(sums.v, 0) END::BIGINT AS total,
    CASE WHEN e.node NOT IN (SELECT node FROM below) THEN coalesce(depth, 0) END::BIGINT AS depth,
    CASE WHEN e.node IN (SELECT node FROM turning) THEN 'cycle' WHEN e.node IN (SELECT node FROM below) THEN 'below cycle' WHEN orphan THEN 'orphan' ELSE 'ok' END AS state
  FROM e LEFT JOIN sums ON sums.anc = e.node LEFT JOIN depths ON depths.node = e.node""")
def hierarchy_states(spark, d):
    """A hierarchy with cycles and parents that are missing: what is sound is summed, the rest reported."""
    key = F.col("p_partkey")
    up = F.when((key % 97 == 1) & (key > 1), 2 * key).when(key % 31 == 0, -key).when(key > 1, F.floor(key / 2))
    rows = read(spark, d, "part").select(key.alias("node"), F.col("p_size").cast("long").alias("v"), up.alias("parent"))
    found = hierarchy.roll_up(rows, rows.where("parent is not null").select("parent", F.col("node").alias("child")), "node", "v")
    return found.select("node", "total", "depth", "state")


@query("""WITH r AS (SELECT (c_custkey * 7919) % 10007 AS priority, c_custkey % 5 AS kind, 'R' || c_custkey AS result, c_custkey,
    CASE c_custkey % 5 WHEN 0 THEN 'PAGO ' || c_name || ' 1-URGENT' WHEN 1 THEN c_name || ' ' WHEN 2 THEN 'PAGO ' || left(c_name, 17) WHEN 3 THEN right(c_name, 7) || ' 3-MEDIUM' ELSE right(c_name, 6) END AS pattern FROM customer),
  t AS (SELECT o_orderkey, 'PAGO ' || c_name || ' ' || o_orderpriority AS text FROM orders JOIN customer ON c_custkey = o_custkey),
  u AS (SELECT DISTINCT text FROM t),
  m AS (SELECT text, arg_min(result, (priority, pattern, result)) AS rule_id FROM u JOIN r ON CASE kind WHEN 0 THEN text = pattern WHEN 2 THEN starts_with(text, pattern) WHEN 3 THEN suffix(text, pattern) ELSE contains(text, pattern) END GROUP BY 1)
  SELECT o_orderkey, coalesce(rule_id, 'SIN-ID') AS rule_id FROM t LEFT JOIN m ON m.text = t.text""")
def rule_index_classify(spark, d):
    """A rule for each customer against the texts of all orders, by an index of the rules' rarest pieces."""
    kinds = map(F.lit, ["equals", "contains", "startswith", "endswith", "contains"])
    key, name = F.col("c_custkey"), F.col("c_name")
    patterns = [F.concat(F.lit("PAGO "), name, F.lit(" 1-URGENT")), F.concat(name, F.lit(" ")), F.concat(F.lit("PAGO "), F.left(name, F.lit(17))), F.concat(F.right(name, F.lit(7)), F.lit(" 3-MEDIUM")), F.right(name, F.lit(6))]
    of = lambda values: F.element_at(F.array(*values), (key % 5 + 1).cast("int"))
    customer = read(spark, d, "customer")
    rules = customer.select((key * 7919 % 10007).alias("priority"), of(kinds).alias("kind"), of(patterns).alias("pattern"), F.concat(F.lit("R"), key).alias("result"))
    orders = read(spark, d, "orders").join(customer, F.col("o_custkey") == key)
    lines = orders.select("o_orderkey", F.concat(F.lit("PAGO "), name, F.lit(" "), "o_orderpriority").alias("text"))
    return rule_index.classify_indexed(lines, "text", rules, "SIN-ID", "rule_id").select("o_orderkey", "rule_id")


def _book(spark, d):
    """Three sheets of cells: sizes, sums down a tree of rows, and totals over four rows that also name a sheet that isn't there."""
    key = F.col("p_partkey")
    a = lambda sheet, k: F.concat(F.lit(sheet), k.cast("string"))
    value = F.when(key > 1, F.concat(a("=Sizes!A", key), a("+$A", F.floor(key / 2)))).otherwise("=Sizes!A1")
    total = F.concat(a("=SUM(Calc!A", key), a(":A$", key + 3), F.when(key % 50 == 0, a(',Gone!B', key)).otherwise(""), F.lit(')&"Calc!A1"'))
    cell = lambda sheet, col, v: F.struct(F.lit(sheet).alias("sheet"), key.cast("int").alias("row"), F.lit(col).alias("col"), v.alias("value"))
    rows = read(spark, d, "part").select(F.inline(F.array(cell("Sizes", 1, F.col("p_size").cast("string")), cell("Calc", 1, value), cell("Totals", 2, total))))
    return rows


_BOOK = """p AS (SELECT p_partkey AS k, p_size FROM part),
  refs AS (SELECT 'Calc' AS sheet, k AS row, 1 AS col, 'Sizes' AS to_sheet, greatest(k, 1) AS r1, greatest(k, 1) AS r2, 1 AS c FROM p UNION ALL SELECT 'Calc', k, 1, 'Calc', k // 2, k // 2, 1 FROM p WHERE k > 1
    UNION ALL SELECT 'Totals', k, 2, 'Calc', k, k + 3, 1 FROM p UNION ALL SELECT 'Totals', k, 2, 'Gone', k, k, 2 FROM p WHERE k % 50 = 0)"""


@query(f"WITH {_BOOK} SELECT sheet, row::INT AS row, col, to_sheet, r1::BIGINT AS first_row, r2::BIGINT AS last_row, c AS first_col, c AS last_col FROM refs")
def cell_references(spark, d):
    """All references of a book's formulas as rows; the one inside quoted text is none."""
    return links.references(_book(spark, d)).drop("token")


@query(f"""WITH {_BOOK} SELECT sheet, row::INT AS row, col, to_sheet, CASE to_sheet WHEN 'Sizes' THEN 'removed sheet' WHEN 'Gone' THEN 'no sheet' ELSE 'no cell' END AS reason FROM refs
  WHERE to_sheet IN ('Sizes', 'Gone') OR NOT EXISTS (SELECT 1 FROM p WHERE k BETWEEN r1 AND r2)""")
def dangling_references(spark, d):
    """References that lead nowhere once the sheet of sizes is removed."""
    return links.dangling(_book(spark, d), ["Sizes"]).drop("token")


@query(f"""WITH RECURSIVE {_BOOK}, calc AS (SELECT k, 1 AS steps FROM p WHERE p_size = 50 UNION SELECT p.k, steps + 1 FROM calc JOIN p ON p.k // 2 = calc.k AND p.k > 1),
  least AS (SELECT k, min(steps) AS steps FROM calc GROUP BY 1)
  SELECT 'Calc' AS sheet, k::INT AS row, 1 AS col, steps::INT AS steps FROM least
  UNION ALL SELECT 'Totals', p.k::INT, 2, min(steps + 1)::INT FROM p JOIN least ON least.k BETWEEN p.k AND p.k + 3 GROUP BY p.k""")
def dependent_cells(spark, d):
    """Every formula that a change of the largest sizes reaches, through chains of formulas and ranges."""
    book = _book(spark, d)
    changed = book.where("sheet = 'Sizes' and value = '50'")
    return links.dependents(book, changed)
