"""Accounting sources as typed tables: ledgers, trial balances, registers, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerbeam.functions.text import strip
from ledgerbeam.operators.lookup import first_rows, last_rows, normal_number
from ledgerbeam.operators.ordered import forward_fill
from ledgerbeam.schema import LEDGER, MONEY, check_schema


def ledger_scan(rows: DataFrame, first: int = 1) -> tuple[DataFrame, DataFrame]:
    """(entries, control total). Row `first` is the report's own total; entries need an account."""
    check_schema(rows, LEDGER)
    control = rows.where(F.col("src_row") == first).select("debit", "credit", (F.col("debit") - F.col("credit")).alias("net"))
    body = rows.where((F.col("src_row") > first) & F.col("account").isNotNull())
    zero = lambda c: F.coalesce(c, F.lit(0).cast(MONEY))
    return (
        body.withColumn("account", strip(F.col("account")))
        .withColumn("description", strip(F.col("description")))
        .withColumn("net", zero(F.col("debit")) - zero(F.col("credit"))),
        control,
    )


#: Columns of the two layouts of a trial balance: account, name, opening, debits, credits, closing.
LAYOUTS = {0: (0, 1, 7, 9, 11, 13), 1: (1, 2, 3, 4, 5, 6)}


def trial_balance(rows: DataFrame, layout: int, version: str) -> DataFrame:
    """A trial balance from rows (src_row, c0, c1, ...) of text: accounts that start with a digit.

    What isn't a number counts as 0; of an account's rows the last wins.
    """
    at = LAYOUTS[layout]
    amount = lambda i, name: F.coalesce(F.col(f"c{i}").try_cast(MONEY), F.lit(0).cast(MONEY)).alias(name)
    named = rows.select(
        "src_row",
        strip(F.col(f"c{at[0]}")).alias("account"),
        F.col(f"c{at[1]}").alias("name"),
        *[amount(i, n) for i, n in zip(at[2:], ("opening", "debits", "credits", "closing"))],
    ).where(F.col("account").rlike("^[0-9]"))
    return last_rows(named, ["account"], ["src_row"]).withColumn("version", F.lit(version))


def register_rows(rows: DataFrame, banks: list[str], numbers: DataFrame, total_label: str = "TOTAL") -> DataFrame:
    """A debt register's rows by kind, with bank and obligation.

    `rows` has (src_row, label, balance, ...) in one sheet's order; `numbers` has (number, obligation_id). Bank
    names head sections, unlabelled rows with a balance are subtotals, numbers match exactly or without leading
    zeros; of a number that is listed several times the smallest obligation_id counts, of those alike but for zeros
    the one of the shortest number.
    """
    named = rows.withColumn("label", F.when(F.col("label").isNotNull(), strip(F.col("label"))))
    is_bank = F.upper("label").isin(*[b.upper() for b in banks])
    bare = normal_number(F.col("label"))
    listed = numbers.select(F.col("number").alias("_n"), F.col("obligation_id").alias("_own"), normal_number(F.col("number")).alias("_b"))
    ids = first_rows(listed.select("_n", "_own"), ["_n"], ["_own"])
    shortest = F.struct(F.length("_n").alias("length"), "_n", "_own")
    bare_ids = listed.groupBy("_b").agg(F.min(shortest)["_own"].alias("_bare"))
    joined = (
        named.withColumn("_key", bare)
        .join(ids, F.col("label") == F.col("_n"), "left")
        .join(bare_ids, F.col("_key") == F.col("_b"), "left")
        .withColumn("obligation_id", F.coalesce("_own", "_bare"))
    )
    kind = (
        F.when(is_bank, "bank")
        .when(F.upper("label").startswith(total_label), "total")
        .when(F.col("obligation_id").isNotNull(), "obligation")
        .when(F.col("label").isNull() & F.col("balance").isNotNull(), "subtotal")
        .otherwise("other")
    )
    marked = joined.withColumn("row_kind", kind).withColumn("_head", F.when(is_bank, F.col("label")))
    return forward_fill(marked, "src_row", "_head", "bank").drop("_key", "_n", "_b", "_bare", "_own", "_head")


def rate_map(rows: DataFrame, first: int = 2, last: int = 7) -> DataFrame:
    """(name, rate) from the head of a register: rows (src_row, label, value) of a window, of a name the last one.

    A value that is no number gives a null rate, which is not the same as a name that is missing.
    """
    named = rows.where(F.col("src_row").between(first, last) & F.col("label").isNotNull())
    pairs = named.select("src_row", strip(F.col("label")).alias("name"), F.col("value").try_cast("double").alias("rate"))
    return last_rows(pairs, ["name"], ["src_row"]).select("name", "rate")


def opening_rows(rows: DataFrame, first: int = 68, last: int = 263) -> DataFrame:
    """A prior year's detail: a fixed window of rows with an account."""
    return rows.where(F.col("src_row").between(first, last) & F.col("aux_account").isNotNull())


_LINE = ("per", "fecha", "saldo_ini", "interes", "capital", "pago", "cuota", "tasa", "ibr", "puntos", "saldo_fin", "ca_saldo")


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _date(c: Column) -> Column:
    """A date from ISO text or a spreadsheet's day number."""
    return F.coalesce(F.try_to_date(F.substr(c, F.lit(1), F.lit(10)), "yyyy-MM-dd"), F.date_add(F.lit("1899-12-30").cast("date"), _number(c).cast("int")))


def _wide(cells: DataFrame, ids: DataFrame, columns: range, tir: bool = False) -> DataFrame:
    """One row for each row of the sheets of `ids`: values of `columns` as c2, c3, ..., and whether it has any.

    All that follows goes by sheet, so this is the only time that cells are dealt out. A sheet has at most some
    million rows, and one task holds it. With `tir` also the row's last cell that reads TIR, the value right of it,
    and whether the row is a header.
    """
    own = cells.join(ids.select("sheet", "id"), "sheet").repartition("sheet")
    texts = strip(F.col("value"))
    more = []
    if tir:
        right = W.partitionBy("sheet", "id", "row").orderBy("col")
        beside = F.when(F.lead("col").over(right) == F.col("col") + 1, F.lead("value").over(right))
        own = own.withColumn("_tir", F.when(texts == "TIR", F.struct("col", beside.alias("v"))))
        more = [F.max("_tir").alias("_tir"), (F.max(texts == "Meses") & F.max(texts == "Saldo inicial")).alias("_head")]
    values = [F.max(F.when(F.col("col") == n, F.col("value"))).alias(f"c{n}") for n in columns]
    return own.groupBy("sheet", "id", "row").agg(*values, F.max(F.col("col").isin(*columns)).alias("_in"), *more)


def _sheet():
    return W.partitionBy("sheet", "id")


def _lines(body: Column, **lines: Column) -> Column:
    """The rows of a sheet that `body` holds for, in order, as structs of all fields of a line."""
    kinds = {"fecha": "date"}
    fields = [lines.get(n, F.lit(None)).cast(kinds.get(n, "double")).alias(n) for n in _LINE]
    return F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("row", F.struct(*fields).alias("f"))))), lambda x: x["f"]).alias("filas")


def _at(row: int, column: str) -> Column:
    return F.max(F.when(F.col("row") == row, F.col(column)))


def lease_tables(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """Lease schedules, nested, one row for each sheet of `ids` (sheet, id).

    Bank and contract are at fixed places, parameters in rows 14 to 29, the rate under the last cell that reads
    TIR; the body is what follows the last header with Meses and Saldo inicial, up to the first row whose period
    or balance is no number. A sheet without header has no rows.
    """
    wide = _wide(cells, ids, range(2, 7), tir=True).withColumn("_header", F.max(F.when(F.col("_head"), F.col("row"))).over(_sheet()))
    there = F.col("_in") & F.coalesce(F.col("row") > F.col("_header"), F.lit(False))
    ok = _number(F.col("c2")).isNotNull() & _number(F.col("c4")).isNotNull()
    wide = wide.withColumn("_stop", F.min(F.when(there & ~ok, F.col("row"))).over(_sheet()))
    body = there & (F.col("_stop").isNull() | (F.col("row") < F.col("_stop")))
    zero = lambda c: F.coalesce(_number(F.col(c)), F.lit(0.0))
    capital = zero("c4") - zero("c6")
    pairs = F.collect_set(F.when(F.col("row").between(14, 29) & F.col("c2").isNotNull(), F.struct(strip(F.col("c2")).alias("k"), F.col("c3").alias("v"))))
    found = wide.groupBy("sheet", "id").agg(
        _at(11, "c2").alias("banco"), _at(12, "c2").alias("contrato"), F.array_sort(pairs).alias("_pairs"),
        F.max(F.when(F.col("_tir").isNotNull(), F.struct("row", F.col("_tir.v").alias("v")))).alias("_tir"),
        _lines(
            body, per=_number(F.col("c2")), fecha=_date(F.col("c3")), saldo_ini=zero("c4"), interes=zero("c5"),
            capital=capital, pago=capital + zero("c5"), saldo_fin=zero("c6"),
        ),
    )
    param = F.when(F.size("_pairs") > 0, F.map_from_entries("_pairs")).alias("param")
    return found.select("sheet", "banco", "contrato", "id", param, _number(F.col("_tir.v")).alias("tir"), "filas", F.lit("L").alias("tipo"))


def loan_tables(cells: DataFrame, ids: DataFrame, first: int = 26) -> DataFrame:
    """Loan schedules, nested: parameters at fixed places, the body from row `first` after leading rows that are none.

    An opening balance is the closing one before it, in the first row the principal.
    """
    wide = _wide(cells, ids, range(2, 12)).withColumn("_p", _number(F.max(F.when(F.col("row") == 6, F.col("c3"))).over(_sheet())))
    there = F.col("_in") & (F.col("row") >= first)
    ok = _number(F.col("c2")).isNotNull() & _number(F.col("c10")).isNotNull()
    wide = wide.withColumn("_start", F.min(F.when(there & ok, F.col("row"))).over(_sheet()))
    wide = wide.withColumn("_stop", F.min(F.when(there & ~ok & (F.col("row") > F.col("_start")), F.col("row"))).over(_sheet()))
    body = there & F.coalesce(F.col("row") >= F.col("_start"), F.lit(False)) & (F.col("_stop").isNull() | (F.col("row") < F.col("_stop")))
    zero = lambda c: F.coalesce(_number(F.col(c)), F.lit(0.0))
    before = _sheet().orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    wide = wide.withColumn("_ini", F.coalesce(F.last(F.when(body, zero("c10")), ignorenulls=True).over(before), F.col("_p")))
    names = {"capital": 6, "plazo": 7, "tasa": 8, "spread": 9, "desembolso": 10}
    found = wide.groupBy("sheet", "id").agg(
        _at(4, "c3").alias("banco"), _at(5, "c3").alias("contrato"), _number(_at(11, "c3")).alias("tir"),
        F.create_map(*[x for n, r in names.items() for x in (F.lit(n), _at(r, "c3"))]).alias("param"),
        _lines(
            body, per=_number(F.col("c2")), fecha=_date(F.col("c3")), saldo_ini=F.col("_ini"), interes=zero("c6"), capital=zero("c5"),
            cuota=zero("c4"), tasa=zero("c7"), ibr=zero("c8"), puntos=zero("c9"), saldo_fin=zero("c10"), ca_saldo=_number(F.col("c11")),
        ),
    )
    return found.select("sheet", "banco", "contrato", "tir", "id", "param", "filas", F.lit("C").alias("tipo"))


def schedule_rows(nested: DataFrame) -> DataFrame:
    """Flat rows of nested schedules: id, type, k, and a line's fields."""
    return nested.select("id", "tipo", F.posexplode("filas").alias("k", "f")).select("id", "tipo", "k", "f.*")
