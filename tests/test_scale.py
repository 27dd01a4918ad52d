"""Sweeps, scans, hierarchies and rule indexes against plain loops, with hot keys and edge rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerbeam.functions import schedule
from ledgerbeam.operators import hierarchy, ranges, rule_index


@pytest.mark.parametrize("with_low,with_high", [(True, True), (False, True), (True, False), (False, False)])
def test_sums_between_bounds_of_hot_and_odd_keys(spark, with_low, with_high):
    rng = random.Random(1)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randint(0, 400))
    facts = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([day(), day(), day(), None]), rng.randint(-50, 50)) for _ in range(400)]
    spine = [(i, rng.choice(["hot", "hot", "a", "none", None]), rng.choice([day(), day(), None]), rng.choice([day(), day(), None])) for i in range(200)]
    spine += [(900, "hot", dt.date(2020, 5, 5), dt.date(2020, 5, 5)), (901, "hot", dt.date(2021, 1, 1), dt.date(2020, 1, 1))] * 2
    s = spark.createDataFrame(spine, "id int, k string, low date, high date")
    f = spark.createDataFrame(facts, "k string, at date, v int").withColumn("v", F.col("v").cast("decimal(18,2)"))
    got = ranges.sums_between(s, f, ["k"], "at", "low", "high", "v", "t", with_low=with_low, with_high=with_high)

    def inside(at, low, high):
        return (low is None or at > low or (with_low and at == low)) and (high is None or at < high or (with_high and at == high))

    want = [(i, sum(v for fk, at, v in facts if fk == k is not None and at is not None and inside(at, low, high))) for i, k, low, high in spine]
    assert sorted((r["id"], int(r["t"])) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ranges.sums_between(s, f.where("false"), ["k"], "at", "low", "high", "v", "t").where("t <> 0").count() == 0


def test_sums_between_numbers(spark):
    s = spark.createDataFrame([(1, 5, 25), (1, None, 9), (2, 0, 10**9)], "k int, low long, high long")
    f = spark.createDataFrame([(1, i, i) for i in range(40)] + [(2, 7 * i, 1) for i in range(100)], "k int, at long, v long")
    got = ranges.sums_between(s, f, ["k"], "at", "low", "high", "v", "t", block=ranges.by_span(10))
    assert sorted((r["k"], r["t"]) for r in got.collect()) == [(1, 45), (1, sum(range(5, 26))), (2, 100)]


@pytest.mark.parametrize("span", [1, 3, 64])
def test_scan_equals_the_fold(spark, span):
    rng = random.Random(2)
    rows = [(i, k, rng.random() * 9, 1000.0 + i, rng.random() / 50) for i, n in enumerate([1, 2, 70, 500]) for k in range(1, n + 1)]
    df = spark.createDataFrame(rows, "id int, k int, payment double, opening double, rate double")
    got = {(r["id"], r["k"]): tuple(r)[2:] for r in schedule.recurrence_scan(df, "id", "k", "payment", "opening", "rate", span).collect()}
    want = {(r["id"], r["k"]): tuple(r)[2:] for r in schedule.recurrence(df, "id", "k", "payment", "opening", "rate").collect()}
    assert set(got) == set(want)
    assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for at in got for a, b in zip(got[at], want[at]))
    assert schedule.recurrence_scan(df.where("false"), "id", "k", "payment", "opening", "rate").count() == 0


def test_one_long_schedule_is_in_many_tasks(spark):
    rows = spark.range(1, 300_001).select(F.lit(1).alias("id"), F.col("id").alias("k"), F.lit(1.0).alias("payment"), F.lit(1e6).alias("opening"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 1e7).alias("rate"))
    as_at_scale = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in as_at_scale.items():
        spark.conf.set(name, value)
    try:
        found = schedule.recurrence_scan(rows, "id", "k", "payment", "opening", "rate").withColumn("task", F.spark_partition_id())
        per_task = [r["n"] for r in found.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()]
        last = found.where("k = 300000").first()["balance_close"]
    finally:
        for name in as_at_scale:
            spark.conf.unset(name)
    assert len(per_task) > 1 and max(per_task) < 200_000
    j = 1e6
    for r in rows.orderBy("k").select("rate").collect():
        j = j + j * r["rate"] - 1.0
    assert abs(last - j) < 1e-6 * abs(j)


def test_roll_up_of_chains_forests_and_cycles(spark):
    edges = [(f"n{i // 2}", f"n{i}") for i in range(1, 64)][1:] + [(f"c{i}", f"c{i + 1}") for i in range(300)]
    edges += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x2", "y"), ("y", "z"), ("s", "s"), ("gone", "o"), ("n1", "twice"), ("n2", "twice")]
    nodes = sorted({n for e in edges for n in e} - {"gone"})
    got = {r["node"]: r for r in hierarchy.roll_up(spark.createDataFrame([(n, 1) for n in nodes] + [("alone", None)], "node string, v long"), spark.createDataFrame(edges, "parent string, child string"), "node", "v").collect()}
    assert (got["n1"]["total"], got["n1"]["depth"]) == (64, 0) and (got["n63"]["total"], got["n63"]["depth"]) == (1, 5)
    assert (got["c0"]["total"], got["c300"]["depth"], got["c100"]["total"]) == (301, 300, 201)
    assert {n for n in got if got[n]["state"] == "cycle"} == {"x1", "x2", "x3", "s"} and got["x1"]["total"] is None
    assert {n for n in got if got[n]["state"] == "below cycle"} == {"y", "z"} and got["y"]["total"] == 2 and got["y"]["depth"] is None
    assert (got["o"]["state"], got["twice"]["state"], got["alone"]["total"]) == ("orphan", "several parents", 0)
    empty = hierarchy.roll_up(spark.createDataFrame([], "node string, v long"), spark.createDataFrame([], "parent string, child string"), "node", "v")
    assert empty.count() == 0


def test_rule_index_equals_all_rules(spark):
    rng = random.Random(4)
    words = ["PAGO", "CRED", "LEAS", "77", "1234", "12345", "ñandú", "x"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "", "."]) for _ in range(rng.randint(0, n)))
    lines = [text(6) for _ in range(300)] + [None, "", "PAGO"]
    rules = [(rng.randint(0, 50), rng.choice(["contains", "startswith", "endswith", "equals"]), text(3), f"r{i}") for i in range(150)]
    rules += [(25, "regex", "^L.*7$", "re"), (3, "contains", ".-", "dots"), (49, "contains", "", "all"), (7, "equals", "PAGO", "paid")]
    holds = {"contains": lambda t, p: p in t, "startswith": str.startswith, "endswith": str.endswith, "equals": str.__eq__, "regex": lambda t, p: t[:1] == "L" and t[-1:] == "7" and len(t) > 1}

    def first(t):
        hits = [(p, pattern, result) for p, kind, pattern, result in rules if t is not None and holds[kind](t, pattern)]
        return min(hits)[2] if hits else "none"

    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(lines)], "id int, text string, priority string")
    got = rule_index.classify_indexed(df, "text", spark.createDataFrame(rules, "priority int, kind string, pattern string, result string"), "none", "rule")
    assert {r["id"]: r["rule"] for r in got.collect()} == {i: first(t) for i, t in enumerate(lines)}
    assert got.columns == ["id", "text", "priority", "rule"]


def test_a_hundred_thousand_rules(spark):
    n = 100_000
    rules = spark.range(n).select((n - F.col("id")).alias("priority"), F.lit("contains").alias("kind"), F.concat(F.lit("PAGO CRED "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" ")).alias("pattern"), F.col("id").cast("string").alias("result"))
    lines = spark.range(0, n, 50).select("id", F.concat(F.lit("nota PAGO CRED "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" fin")).alias("text"))
    got = rule_index.classify_indexed(lines, "text", rules, "none", "rule")
    assert got.where("rule <> cast(id as string)").count() == 0 and got.count() == n // 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_links_of_a_small_book(spark):
    from ledgerbeam.operators import links

    rows = [
        ("In", 1, 1, "5"), ("In", 2, 1, "6"), ("In", 5000, 28, "7"), ("Out", 1, 1, "=In!$A$1*2"), ("Out", 2, 1, "=SUM(In!A:A)+\"In!A1\""), ("Out", 3, 1, "=A1+A2"),
        ("Out", 4, 1, "=SUM(In!Z4000:AB6000)"), ("Out", 5, 1, "=A6"), ("Out", 6, 1, "=A5+In!C9"), ("Out", 7, 1, "='It''s'!B2"), ("It's", 2, 2, "=Out!A3"), ("Out", 8, 1, None), ("Out", 9, 1, "=SUM(A1:B3,A1)"),
    ]
    cells = spark.createDataFrame(rows, "sheet string, row int, col int, value string")
    refs = {(r["row"], r["token"]): tuple(r)[4:] for r in links.references(cells).where("sheet = 'Out'").collect()}
    assert refs[1, "In!$A$1"] == ("In", 1, 1, 1, 1) and refs[2, "In!A:A"] == ("In", None, None, 1, 1) and refs[4, "In!Z4000:AB6000"] == ("In", 4000, 6000, 26, 28)
    assert (2, "In!A1") not in refs and refs[7, "'It''s'!B2"] == ("It's", 2, 2, 2, 2)
    assert [tuple(r)[:3] + (r["reason"],) for r in links.dangling(cells).collect()] == [("Out", 6, 1, "no cell")]
    left, broken = links.without_sheets(cells, ["In"])
    assert left.where("sheet = 'In'").count() == 0 and sorted(r["row"] for r in broken.collect()) == [1, 2, 4, 6]
    place = lambda *at: spark.createDataFrame(list(at), "sheet string, row int, col int")
    reach = lambda df: {(r["sheet"], r["row"]): r["steps"] for r in df.collect()}
    assert reach(links.dependents(cells, place(("In", 1, 1)))) == {("Out", 1): 1, ("Out", 2): 1, ("Out", 3): 2, ("Out", 9): 2, ("It's", 2): 3, ("Out", 7): 4}
    assert reach(links.dependents(cells, place(("Out", 5, 1)))) == {("Out", 6): 1, ("Out", 5): 2}  # a cycle
    assert reach(links.dependents(cells, place(("In", 5000, 28)))) == {("Out", 4): 1}
    assert links.dependents(cells, place(("In", 1, 1)).where("false")).count() == 0
    assert links.references(cells.where("false")).count() == 0


def test_dependents_against_a_search_and_without_broadcasts(spark, monkeypatch, tmp_path):
    """Ranges of all lengths, whole columns, cycles, a target of many formulas; no join may rest on an estimate."""
    from ledgerbeam.operators import links

    rng = random.Random(5)
    rows, named = [], {}
    for sheet in ("A", "B"):
        for row in range(120):
            for col in (1, 2):
                to, first, c = rng.choice("AB"), rng.randrange(130), rng.choice((1, 2, 2, 3))
                last, whole = first + rng.choice((0, 0, 1, 3, 6, 20, 70)), rng.random() < 0.02
                if rng.random() < 0.7:
                    rows.append((sheet, row, col, "5"))
                    continue
                rows.append((sheet, row, col, f"=SUM({to}!A:{'ABC'[c - 1]})+B!C9" if whole else f"={to}!A{first}:{'ABC'[c - 1]}${last}*2"))
                named[sheet, row, col] = (to, 0 if whole else first, 999 if whole else last, c)
    rows.append(("B", 9, 3, "=A9223372036854775807"))
    start = ("A", 60, 1)
    want, front, steps = {}, {start}, 0
    while front:
        steps += 1
        hit = {f for f, (to, a, z, c) in named.items() if any(s == to and a <= r <= z and k <= c for s, r, k in front)}
        front = {f for f in hit if f not in want}
        want |= dict.fromkeys(front, steps)
    assert steps > 4
    plans, was = [], spark.conf.get("spark.sql.adaptive.enabled")

    def cut(df, made=links.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return made(df)

    monkeypatch.setattr(links, "cut", cut)
    monkeypatch.setattr(links, "PART", 50, raising=False)
    spark.createDataFrame(rows, "sheet string, row int, col int, value string").write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")  # of a few kB, as Spark sees it
    found = links.dependents(cells, spark.createDataFrame([start], "sheet string, row int, col int"))
    assert found.columns == ["sheet", "row", "col", "steps"]
    assert {tuple(r)[:3]: r["steps"] for r in found.collect()} == want and found.count() == len(want)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]
    assert spark.conf.get("spark.sql.adaptive.enabled") == was


def test_versions_compare_by_digests(spark):
    from ledgerbeam.operators import versions

    a = spark.range(20_000).select("id", F.concat(F.lit("n"), F.col("id") % 7).alias("name"), (F.col("id") * 2).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("w"))
    shuffled = a.repartition(7).orderBy(F.desc("v"))
    one, two = versions.digests(a, ["id"], ["v", "w"]), versions.digests(shuffled, ["id"], ["v", "w"])
    assert versions.differing(one, two) == []
    broken = a.select("id", F.raise_error(F.lit("read")).cast("long").alias("v"), F.lit(1).cast("long").alias("w"))
    assert versions.changes(broken, broken, ["id"], ["v", "w"], trees=(one, two)).count() == 0  # equal versions read no row
    b = a.where("id <> 77").withColumn("v", F.when(F.col("id") == 5000, 1).otherwise(F.col("v"))).withColumn("w", F.when(F.col("id") == 10, F.lit(3)).otherwise(F.col("w")))
    b = b.union(spark.createDataFrame([(99_999, "x", 4, None)], "id long, name string, v long, w long"))
    got = versions.changes(a, b, ["id"], ["v", "w"])
    assert sorted((r["id"], r["diff_v"], r["diff_w"], r["status"]) for r in got.collect()) == [(10, 0, -3, "both"), (77, 154, 77, "only in first"), (5000, 9999, 0, "both"), (99_999, -4, 0, "only in second")]
    assert len(versions.differing(one, versions.digests(b, ["id"], ["v", "w"]))) == 4
    none = a.where("false")
    assert versions.changes(none, none, ["id"], ["v", "w"]).count() == 0 and versions.changes(none, a.limit(3), ["id"], ["v"]).count() == 3


def test_bucketed_tables_sum_without_a_shuffle(spark):
    from ledgerbeam.operators import criteria
    from ledgerbeam.plans.tables import ledger, register
    from ledgerbeam.sources import layout

    d = "/root/testdata/sf0.001"
    lines = layout.save_bucketed(ledger(spark, d), "lb_ledger_by_obligation", "obligation_id", 4, ["account"])
    debts = layout.save_bucketed(register(spark, d), "lb_register_by_obligation", "obligation_id", 4)
    try:
        picked = lines.where(layout.begins("account", "r"))
        got = criteria.attach(debts.select("obligation_id", "balance"), picked, ["obligation_id"], total=F.sum("amount"))
        plan = got._jdf.queryExecution().toString()
        assert "Exchange hashpartitioning" not in plan and "StringStartsWith(account_folded,R)" in plan
        want = criteria.attach(register(spark, d).select("obligation_id", "balance"), ledger(spark, d).where("account like 'R%'"), ["obligation_id"], total=F.sum("amount"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert lines.where(layout.is_text("account", "rf")).count() == ledger(spark, d).where("account = 'RF'").count()
    finally:
        spark.sql("DROP TABLE lb_ledger_by_obligation")
        spark.sql("DROP TABLE lb_register_by_obligation")
