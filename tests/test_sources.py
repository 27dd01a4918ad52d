"""Workbooks, typed sources, sinks and the stream."""

import datetime as dt
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerbeam.schema import LEDGER
from ledgerbeam.sources import readers, sinks, workbook
from ledgerbeam.streaming.tieout import tie_out_stream, windowed_sums


def write_xlsx(path, sheets):
    """A small workbook: sheet name to {(row, col): text}."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    letter = lambda c: chr(64 + c)
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml" Type="t"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        strings = sorted({v for cells in sheets.values() for v in cells.values()})
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        for i, cells in enumerate(sheets.values(), 1):
            rows = ""
            for r in sorted({r for r, _ in cells}):
                own = "".join(f'<c r="{letter(c)}{r}" t="s"><v>{strings.index(v)}</v></c>' for (rr, c), v in sorted(cells.items()) if rr == r)
                rows += f'<row r="{r}">{own}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")


LEASE = {
    (11, 2): "Bank A", (12, 2): "L-77", (14, 2): "Plazo", (14, 3): "36", (15, 2): "Tasa ", (15, 3): "0.1",
    (30, 2): "TIR", (30, 3): "0.012", (32, 2): "Meses", (32, 4): "Saldo inicial",
    (33, 2): "1", (33, 3): "2025-01-31", (33, 4): "100", (33, 5): "2", (33, 6): "90",
    (34, 2): "2", (34, 3): "2025-02-28", (34, 4): "90", (34, 5): "1", (34, 6): "95",
    (35, 2): "total", (36, 2): "3", (36, 4): "1",
}
LOAN = {
    (4, 3): "Bank B", (5, 3): "77", (6, 3): "500", (11, 3): "0.02", (26, 2): "note",
    (27, 2): "1", (27, 3): "45688", (27, 5): "200", (27, 6): "5", (27, 10): "300", (28, 2): "2", (28, 5): "300", (28, 10): "0", (29, 2): "end",
}


def test_schedules_from_a_workbook(spark, tmp_path):
    write_xlsx(tmp_path / "book.xlsx", {"L1": LEASE, "C1": LOAN})
    cells = workbook.read_workbooks(spark, str(tmp_path / "*.xlsx"), 45)
    lease = readers.lease_tables(cells, spark.createDataFrame([("L1", "A-L77")], "sheet string, id string")).first()
    assert (lease["banco"], lease["contrato"], lease["tir"], lease["param"]) == ("Bank A", "L-77", 0.012, {"Plazo": "36", "Tasa": "0.1"})
    assert [(f["per"], f["fecha"], f["capital"], f["pago"]) for f in lease["filas"]] == [(1.0, dt.date(2025, 1, 31), 10.0, 12.0), (2.0, dt.date(2025, 2, 28), -5.0, -4.0)]
    loans = readers.loan_tables(cells, spark.createDataFrame([("C1", "B-77")], "sheet string, id string"))
    loan = loans.first()
    assert loan["tir"] == 0.02 and loan["param"]["capital"] == "500"
    assert [(f["fecha"], f["saldo_ini"], f["capital"], f["saldo_fin"]) for f in loan["filas"]] == [(dt.date(2025, 1, 31), 500.0, 200.0, 300.0), (None, 300.0, 300.0, 0.0)]
    assert '"fecha":"2025-01-31"' in sinks.schedules_json(loans).first()["json"]
    flat = readers.schedule_rows(loans)
    assert tuple(sinks.schedule_summary(flat, dt.date(2025, 6, 30)).first()) == ("B-77", 2, 1.0, 300.0)


def test_ledger_scan_splits_the_control_total(spark):
    line = lambda n, acc, d, c: (n, acc, None, None, d, c, None, None, None, None, " x\t", None)
    rows = [line(1, None, Decimal(9), Decimal(4)), line(2, " 2105 ", Decimal(9), None), line(3, None, Decimal(1), None), line(4, "2130", None, Decimal(4))]
    body, control = readers.ledger_scan(spark.createDataFrame(rows, LEDGER))
    assert [(r["account"], r["net"], r["description"]) for r in body.orderBy("src_row").collect()] == [("2105", 9, "x"), ("2130", -4, "x")]
    assert tuple(control.first()) == (9, 4, 5)


def test_trial_balance_layouts(spark):
    rows = [(1, "Cuenta", "n", "x", "", "", ""), (2, " 2105", "Loans", "10", "n/d", "1", "9"), (3, "2105", "Loans", "11", "2", "3", "10")]
    df = spark.createDataFrame(rows, "src_row int, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string")
    got = readers.trial_balance(df, 1, "v2").collect()
    assert [(r["account"], r["opening"], r["debits"], r["version"]) for r in got] == [("2105", 11, 2, "v2")]


def test_register_sections(spark):
    rows = [(1, "Bank A", None), (2, "00123", 5), (3, "456", 6), (4, None, 11), (5, "Bank B", None), (6, "9", 1), (7, "TOTAL", 12), (8, None, None)]
    numbers = spark.createDataFrame([("123", "A-123"), ("456", "A-456"), ("0009", "B-9")], "number string, obligation_id string")
    got = readers.register_rows(spark.createDataFrame(rows, "src_row int, label string, balance int"), ["Bank A", "Bank B"], numbers).orderBy("src_row").collect()
    assert [r["row_kind"] for r in got] == ["bank", "obligation", "obligation", "subtotal", "bank", "obligation", "total", "other"]
    assert [r["obligation_id"] for r in got if r["row_kind"] == "obligation"] == ["A-123", "A-456", "B-9"]
    assert [r["bank"] for r in got] == ["Bank A"] * 4 + ["Bank B"] * 4


def test_manifest(spark, tmp_path):
    m = sinks.save_results({"b": spark.range(3), "a": spark.range(1)}, str(tmp_path / "out"))
    assert [(r["name"], r["rows"]) for r in m.orderBy("ord").collect()] == [("b", 3), ("a", 1)]
    assert [(n, df.count()) for n, df in sinks.load_results(spark, str(tmp_path / "out")).items()] == [("b", 3), ("a", 1)]


def test_a_run_that_fails_leaves_the_last_one(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.save_results({"a": spark.range(4), "none": spark.range(0)}, path)
    with pytest.raises(Exception, match="broken"):
        sinks.save_results({"a": spark.range(9), "b": spark.range(1).select(F.raise_error(F.lit("broken")))}, path)
    assert {n: df.count() for n, df in sinks.load_results(spark, path).items()} == {"a": 4, "none": 0}


def test_sums_after_marks_as_lines_arrive(spark, tmp_path):
    from ledgerbeam.operators.criteria import max_then_sum_after
    from ledgerbeam.streaming.marks import sums_after_marks

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.to_date("ts").alias("day"), "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
    events.orderBy(F.xxhash64("day", "value")).repartition(5).write.parquet(str(tmp_path / "in"))  # late lines and late marks
    mark = (F.col("event_type") == "error") & (F.col("value") > 10)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}

    def keep(batch, _):
        seen.update({r["user_id"]: (r["last_mark"], r["accrued"]) for r in batch.collect()})

    query = sums_after_marks(stream, "user_id", "day", mark, F.col("value")).writeStream.outputMode("update").foreachBatch(keep)
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    want = max_then_sum_after(events.select("user_id").distinct(), events, ["user_id"], "day", mark, F.col("value"), "accrued", "last_mark")
    assert seen == {r["user_id"]: (r["last_mark"], r["accrued"]) for r in want.collect()} and any(m for m, _ in seen.values())


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    tie_out_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    last = events.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    want = windowed_sums(events).where(F.col("start") + F.expr("interval 1 day") <= F.lit(last))
    got = spark.read.parquet(str(tmp_path / "out"))
    show = lambda df: sorted((str(r["start"]), r["event_type"], r["n"], round(r["net"], 6)) for r in df.collect())
    assert show(got) == show(want) and got.count() > 10


def test_schedule_bodies_in_one_pass(spark, tmp_path):
    """Rows with cells in other columns only end no body; headers, starts and stops of many sheets; few shuffles."""
    import re

    lease = [("L", 11, 2, "Bank"), ("L", 12, 2, "7"), ("L", 20, 2, " TIR"), ("L", 20, 3, "0.5"), ("L", 25, 5, "TIR"), ("L", 25, 7, "9")]
    lease += [("L", r, c, v) for r in (30, 34) for c, v in ((2, "Meses"), (4, "Saldo inicial"))]
    lease += [("L", r, c, str(v)) for r, v in ((31, 1), (35, 1), (36, 2), (38, 3), (40, 4)) for c in (2, 4, 5, 6)] + [("L", 37, 9, "x"), ("L", 39, 2, "stop"), ("M", 1, 1, "no header")]
    loan = [("C", 4, 3, "Bank"), ("C", 6, 3, "100")] + [("C", r, c, str(v)) for r, v in ((28, 60), (30, 20)) for c in (2, 10)] + [("C", 26, 2, "note"), ("C", 29, 12, "x"), ("C", 31, 2, "end"), ("C", 32, 2, "5"), ("C", 32, 10, "5")]
    path = str(tmp_path / "cells.parquet")
    spark.createDataFrame(lease + loan, "sheet string, row int, col int, value string").write.parquet(path)
    cells = spark.read.parquet(path)
    ids = spark.createDataFrame([("L", "a"), ("L", "b"), ("M", "m"), ("gone", "g")], "sheet string, id string")
    got = {r["id"]: r for r in readers.lease_tables(cells, ids).collect()}
    assert set(got) == {"a", "b", "m"} and [f["per"] for f in got["a"]["filas"]] == [1.0, 2.0, 3.0] == [f["per"] for f in got["b"]["filas"]]
    assert (got["a"]["tir"], got["m"]["filas"], got["m"]["param"]) == (None, [], None)  # the last TIR has nothing right of it
    loans = readers.loan_tables(cells, spark.createDataFrame([("C", "c")], "sheet string, id string"))
    assert [(f["saldo_ini"], f["saldo_fin"]) for f in loans.first()["filas"]] == [(100.0, 60.0), (60.0, 20.0)]
    for df in (readers.lease_tables(cells, ids), loans):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"(?<!Broadcast)Exchange ", plan)) <= 3
