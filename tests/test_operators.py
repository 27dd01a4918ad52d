"""Operators on small frames with results worked out by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerbeam.functions import finance, refs, schedule, text
from ledgerbeam.operators import classify, criteria, lookup, ordered, recon, rules
from ledgerbeam.plans import report
from ledgerbeam.schema import Params, check_schema

VALUES = ["BOG-L1", "bog-2", "DAV-L3", "", None, "1000", "7"]
FORMS = {
    "BOG-*": [True, True, False, False, False, False, False],
    "*-l*": [True, False, True, False, False, False, False],
    "<>bog*": [False, False, True, True, True, True, True],
    "<>": [True, True, True, False, False, True, True],
    "": [False, False, False, True, True, False, False],
    ">=1000": [False, False, False, False, False, True, False],
    "<>1000": [True, True, True, True, True, False, True],
    "?": [False, False, False, False, False, False, True],
    "bog-2": [False, True, False, False, False, False, False],
    "d~*": [False] * 7,
    "b?g-2": [False, True, False, False, False, False, False],
    1000: [False, False, False, False, False, True, False],
}


@pytest.mark.parametrize("form", FORMS)
def test_criteria(spark, form):
    df = spark.createDataFrame(list(enumerate(VALUES)), "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(criteria.criterion(F.col("v"), form)).collect()] == FORMS[form]


def test_sum_of_nothing_is_zero_and_same_day_is_left_out(spark):
    spine = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    d = dt.date
    facts = spark.createDataFrame(
        [("a", d(2020, 1, 1), 0, 5), ("a", d(2020, 2, 1), 1, 7), ("a", d(2020, 2, 1), 0, 9), ("a", d(2020, 3, 1), 0, 11), ("b", d(2020, 1, 1), 0, 3)],
        "k string, day date, mark int, v long",
    )
    got = criteria.max_then_sum_after(spine, facts, ["k"], "day", F.col("mark") == 1, F.col("v"), "s", "last").orderBy("k").collect()
    assert [(r["k"], r["s"], r["last"]) for r in got] == [("a", 11, d(2020, 2, 1)), ("b", 3, None), ("c", 0, None)]
    assert [r["t"] for r in criteria.sumifs(spine, facts, ["k"], "v", "t", mark=1).orderBy("k").collect()] == [7, 0, 0]


def test_lookups(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 2, "late"), (1, 1, "early")], "k int, o int, v string")
    assert [tuple(r) for r in lookup.lookup(left, right, ["k"], ["o"], ["v"]).orderBy("k").collect()] == [(1, "early"), (2, None)]
    with pytest.raises(Exception, match="no match for"):
        lookup.lookup_strict(left, right, ["k"], ["o"], ["v"]).collect()
    assert [r["v"] for r in lookup.last_rows(right, ["k"], ["o"]).collect()] == ["late"]


def test_movement_types(spark):
    rows = [("2130", 0, 5, "x"), ("2130", 999, 0, "x"), ("2130", 1000, 0, "x"), ("2105", 1, 1, "x"), ("2105", 0, 1, "x"), ("2105", 0, 0, "x"), ("2105", 1, 0, "TC"), ("2105", 1, 0, "N/A-Z")]
    df = spark.createDataFrame(rows, "a string, d int, c int, o string")
    got = [r[0] for r in df.select(rules.movement_type(*map(F.col, "adco"))).collect()]
    assert got == ["accrual", "rounding", "reversal", "renewal", "drawdown", "principal payment", "card", "reclassification"]


def test_first_rule_wins(spark):
    chain = rules.classify([rules.Rule("one", (("t", "contains", "ab"),)), rules.Rule("two", (("t", "regex", "a"),))], "none")
    df = spark.createDataFrame([("ab",), ("a",), ("z",), (None,)], "t string")
    assert [r[0] for r in df.select(chain).collect()] == ["one", "two", "none", "none"]


def test_gloss(spark):
    rows = ["INTERESES: 1.234.567.89", "INTERESES $1.234.567", "INTERESE 1234567", "INTERESES 1,234", "INTERES 500", "intereses 500", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [tuple(r) for r in df.select(text.gloss_amount(F.col("t")), text.gloss_status(F.col("t"))).collect()]
    assert got == [(1234567.89, "parsed"), (1234567.0, "parsed"), (1234567.0, "parsed"), (None, "unreadable"), (None, "absent"), (None, "absent"), (None, "absent")]


def test_formats(spark):
    df = spark.createDataFrame([(2.5, " \ta b\n")], "x double, s string")
    assert tuple(df.select(text.amount_text(F.col("x"), "$"), text.strip(F.col("s")), text.percent_text(F.lit(0.125))).first()) == ("$3", "a b", "13%")


def test_basis_tie_goes_to_365(spark):
    row = spark.range(1).select(finance.best_basis(F.lit(10.0), F.lit(11.0), F.lit(9.0)), finance.best_basis(F.lit(10.0), F.lit(12.0), F.lit(9.0))).first()
    assert tuple(row) == (1.0, -1.0)


def test_portions(spark):
    year = Params().next_year
    rows = [(100, dt.date(2030, 1, 1), None, -5), (100, year, 7, 7), (0, None, 7, 7), (100, None, 170, 7), (100, None, None, 70), (100, None, None, None)]
    df = spark.createDataFrame(rows, "b int, m date, s int, c int")
    got = [tuple(r[0]) for r in df.select(classify.current_portion(F.col("b"), F.col("m"), F.col("s"), F.col("c"), year)).collect()]
    assert got == [(0, "ledger"), (100, "matures within twelve months"), (0, "no balance"), (100, "schedule"), (70, "ledger"), (None, "ledger")]


def test_conclusions(spark):
    rows = [(100, None, 100), (100, 101, 99), (100, 101, 300), (100, 300, 100), (100, 101, None)]
    df = spark.createDataFrame(rows, "l int, b int, r int")
    got = [r[0] for r in df.select(recon.balance_conclusion(*map(F.col, "lbr"), 5)).collect()]
    assert got == ["pending", "OK", "register stale", "difference", "register stale"]


def test_hierarchy_and_waterfall(spark):
    nodes = spark.createDataFrame([("p", 10), ("a", 4), ("b", 5)], "k string, v int")
    edges = spark.createDataFrame([("p", "a"), ("p", "b")], "parent string, child string")
    row = recon.hierarchy_proof(nodes, edges, "k", "v", 0).first()
    assert (row["children"], row["diff"], row["verdict"]) == (9, 1, "DIFERENCIA")
    one = lambda x: spark.createDataFrame([(x,)], "amount long")
    got = [(r["item"], r["amount"]) for r in recon.waterfall(one(10), [("a", one(3)), ("b", one(5))]).orderBy("step").collect()]
    assert got == [("total", 10), ("a", 3), ("b", 5), ("residual", 2), ("check", 0)]


def test_forward_fill_over_block_edges(spark):
    rows = [(i, "h" + str(i) if i in (3, 10, 37) else None) for i in range(60)]
    got = [r["f"] for r in ordered.forward_fill(spark.createDataFrame(rows, "i long, v string"), "i", "v", "f", 8).orderBy("i").collect()]
    assert got == [None] * 3 + ["h3"] * 7 + ["h10"] * 27 + ["h37"] * 23


def test_body(spark):
    rows = [("s", i, v) for i, v in enumerate(["x", "1", "2", "x", "3"])]
    df = spark.createDataFrame(rows, "s string, r int, v string")
    ok = F.col("v").rlike("^[0-9]$")
    assert [r["r"] for r in ordered.take_body(df, ["s"], "r", ok, True).orderBy("r").collect()] == [1, 2]
    assert ordered.take_body(df, ["s"], "r", ok, False).count() == 0


def test_closed_form_equals_recurrence(spark):
    rows = [("a", k, 120.0 + 7 * k, 1000.0, 0.0123) for k in range(1, 13)] + [("b", k, -5.0, 10.0, 0.02) for k in range(1, 4)]
    df = spark.createDataFrame(rows, "id string, k long, p double, j0 double, n double")
    a = schedule.lease_closed_form(df, "id", "k", "p", "j0", "n").orderBy("id", "k").collect()
    b = schedule.recurrence(df, "id", "k", "p", "j0", "n").orderBy("id", "k").collect()
    assert all(abs(x["balance_close"] - y["balance_close"]) < 1e-8 and abs(x["interest"] - y["interest"]) < 1e-8 for x, y in zip(a, b, strict=True))


def test_recurrence_in_stretches_rounds_period_by_period(spark):
    rows, want = [], {}
    for n in (1, 63, 64, 65, 130):
        j = 1000.0
        for k in range(1, n + 1):
            p, r = 20.0 + k % 7, 0.01 + k % 5 / 1000
            rows.append((n, k, p, 1000.0, r))
            want[n, k] = (j, j * r, j + j * r - p)
            j = want[n, k][2]
    df = spark.createDataFrame(rows, "id int, k long, p double, j0 double, n double")
    got = {(r["id"], r["k"]): tuple(r)[2:] for r in schedule.recurrence(df, "id", "k", "p", "j0", "n").collect()}
    assert got == want


MOVES = {"Old": refs.Move("New", 10, 11, 30), "My Sheet": refs.Move("New", 40, 41, 60)}
FORMULAS = [
    ("=Old!A1+B2", "Main", "=New!A11+B2"),
    ("=A$1+$B$2", "Old", "=A$11+$B$12"),
    ("=SUM('My Sheet'!C:C)", "Old", "=SUM(C$41:C$60)"),
    ("=SUM('My Sheet'!$C1:D3,Other!A1)", "Main", "=SUM(New!$C41:D43,Other!A1)"),
    ('=IF(Old!A1="Old!A1","x",LOG10(2))', "Main", '=IF(New!A11="Old!A1","x",LOG10(2))'),
    ("='Gone'!A1", "Main", "='Here now'!A1"),
    ("plain A1", "Old", "plain A1"),
    (None, "Old", None),
]


def test_references(spark):
    df = spark.createDataFrame([(f, here, want) for f, here, want in FORMULAS], "f string, here string, want string")
    got = df.select(refs.translate(F.col("f"), F.col("here"), MOVES, {"Gone": "Here now"}).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_translation_without_moves_changes_nothing(spark):
    rng = random.Random(3)
    bodies = ["".join(rng.choices("AB12!$\":'(,+ é\n", k=rng.randint(0, 20))) for _ in range(3000)]
    df = spark.createDataFrame([("=" + b,) for b in bodies], "f string")
    assert df.where(refs.translate(F.col("f"), F.lit("Main"), {}) != F.col("f")).count() == 0


def test_sheet_names_with_quotes(spark):
    moves = {"It's": refs.Move("Sam's", 1, 2, 9)}
    row = spark.range(1).select(refs.translate(F.lit("='It''s'!A1+'It''s'!B:B"), F.lit("Main"), moves)).first()
    assert row[0] == "='Sam''s'!A2+'Sam''s'!B$2:B$9"


def test_formulas_by_both_ways_of_cutting(spark):
    """Names that look like references; long, unfinished and doubled quotes; characters that part records."""
    bodies = [
        ("LOG10(A1)+LOG10 (A1)", "LOG10(A11)+LOG20 (A11)"), ("SUM(Old!A1:B2,'Old'!$C$3)&\"é'!\"", "SUM(A11:B12,$C$13)&\"é'!\""), ("A1!B2+Old!x+Añ!A1", "A1!B2+Old!x+Añ!A1"), ("Gone!A$1+Gone!B:C", "'Here now'!A$1+'Here now'!B:C"),
        ('"A1""A1"&A1&"A1""A1', '"A1""A1"&A11&"A1""A11'), ("'My Sheet'!A1&'My Sheet&A1", "A41&'My Sheet&A11"), ("'My Sheet'!$A:$B", "$A$41:$B$60"), ("", ""), ("A1$B2:C3\nA1", "A11$B12:C13\nA11"), ("A:A*ABCD1*A1B*A99999999999999999999", "A$11:A$30*ABCD1*A1B*A$11"),
    ]
    bodies += [('"' + 'x""' * 20_000 + '"&A1', '"' + 'x""' * 20_000 + '"&A11'), ("A1+" * 2_000 + "-" * 20_000 + "f(" * 9_000, "A11+" * 2_000 + "-" * 20_000 + "f(" * 9_000)]
    bodies += [(f + '&"' + mark + '"+A2', want + '&"' + mark + '"+A12') for f, want in bodies if f.count('"') % 2 == 0 and f.count("'") % 2 == 0 for mark in ("\x01", "\x02\x01")]
    df = spark.createDataFrame([("=" + f, "=" + want) for f, want in bodies], "f string, want string")
    moves = {"Old": refs.Move("Old", 10, 11, 30), "My Sheet": refs.Move("Old", 40, 41, 60)}
    rows = df.select(refs.translate(F.col("f"), F.lit("Old"), moves, {"Gone": "Here now"}).alias("got"), "want").collect()
    assert [r["got"][:300] for r in rows if r["got"] != r["want"]] == []


def test_translation_makes_no_exception_and_cuts_a_formula_once(spark):
    """A cast of an empty text throws and catches inside; an expression named twice in a lambda is worked out twice."""
    df = spark.createDataFrame([("=A1",)], "f string").select(refs.translate(F.col("f"), F.lit("Old"), MOVES).alias("got"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("regexp_extract(") == 0


def test_cells_keep_their_origin(spark):
    cells = spark.createDataFrame([("Old", 1, 1, "=A2"), ("Old", 2, 1, "5"), ("Main", 1, 1, "=Old!A1")], "sheet string, row int, col int, value string")
    got = sorted(tuple(r) for r in refs.translate_cells(cells, MOVES).collect())
    assert got == [("Main", 1, 1, "=New!A11", "Main", 1, False), ("New", 11, 1, "=A12", "Old", 1, True), ("New", 12, 1, "5", "Old", 2, False)]


def test_stack(spark):
    a = spark.createDataFrame([("x",), ("y",)], "label string")
    b = spark.createDataFrame([("z", 1)], "label string, n int")
    got = [(r["label"], r["row_no"], r["n"]) for r in report.stack([("A", a, ["label"]), ("B", b, ["label"])]).orderBy("row_no").collect()]
    assert got == [("x", 2, None), ("y", 3, None), ("z", 7, 1)]


def test_schema_check(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="column a is int"):
        check_schema(df, spark.createDataFrame([], "a string").schema)
    with pytest.raises(ValueError, match="missing"):
        check_schema(df, spark.createDataFrame([], "b string").schema)
