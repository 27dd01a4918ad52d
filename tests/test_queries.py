"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from ledgerbeam.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "null" if v is None else f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    found = duck.execute(ORACLES[name])
    have = [c[0] for c in found.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ORACLES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_internal_rate_is_a_root(spark):
    from pyspark.sql import functions as F

    from ledgerbeam.functions import finance

    flows = spark.createDataFrame([([-100.0, 60.0, 60.0],), ([-100.0, 10.0],), ([1.0, 2.0],), ([],)], "f array<double>")
    rows = flows.select(finance.irr(F.col("f")).alias("r"), "f").collect()
    assert abs(sum(x / (1 + rows[0]["r"]) ** k for k, x in enumerate(rows[0]["f"]))) < 1e-9
    assert rows[1]["r"] is None or abs(rows[1]["r"] + 0.9) < 1e-9
    assert rows[2]["r"] is None and rows[3]["r"] is None
    found = QUERIES["irr_bisection"](spark, SF)
    assert found.where("irr is not null").count() > 0
