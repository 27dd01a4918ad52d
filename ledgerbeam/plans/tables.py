"""The driver's tables seen as accounting sources, in Spark and in SQL.

Ledger: order lines, debits where returned. Register: orders, with rates and portions that follow from their
keys. Accounts: the two flags of a line. Obligations: orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerbeam.schema import Params

PARAMS = Params()
MONEY = "decimal(18,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    amount = F.col("l_extendedprice").cast(MONEY)
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("obligation_id"),
        F.concat("l_returnflag", "l_linestatus").alias("account"),
        F.to_date("l_shipdate").alias("entry_date"),
        F.col("l_linenumber").alias("line_no"),
        "l_partkey",
        "l_suppkey",
        F.col("l_discount").alias("rate"),
        amount.alias("amount"),
        F.when(returned, amount).otherwise(0).cast(MONEY).alias("debit"),
        F.when(returned, 0).otherwise(amount).cast(MONEY).alias("credit"),
    )


LEDGER = """ledger AS (
  SELECT l_orderkey AS obligation_id, l_returnflag || l_linestatus AS account, CAST(l_shipdate AS DATE) AS entry_date,
    l_linenumber AS line_no, l_partkey, l_suppkey, l_discount AS rate, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
    CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END AS debit,
    CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS credit
  FROM lineitem)"""


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, balance = F.col("o_orderkey"), F.col("o_totalprice").cast(MONEY)
    current = (balance * ((key % 7) - 1) / F.lit(5)).cast(MONEY)
    gap = F.when(key % 11 == 0, F.lit(5)).otherwise(F.lit(0))
    return read(spark, sf_dir, "orders").select(
        key.alias("obligation_id"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("status"),
        balance.alias("balance"),
        F.col("o_orderpriority").alias("rate_type"),
        ((key % 50) / F.lit(10000.0)).alias("spread"),
        (key % 12 + 1).cast("int").alias("periods"),
        F.to_date("o_orderdate").alias("start"),
        F.date_add(F.to_date("o_orderdate"), (key % 900).cast("int")).alias("maturity"),
        current.alias("current"),
        (balance - current + gap).cast(MONEY).alias("noncurrent"),
    )


#: The current portion is rounded half up by hand: the engines differ in how they round decimal quotients.
REGISTER = """register AS (
  SELECT o_orderkey AS obligation_id, o_custkey AS custkey, o_orderstatus AS status, b AS balance,
    o_orderpriority AS rate_type, (o_orderkey % 50) / 10000.0::DOUBLE AS spread, (o_orderkey % 12 + 1)::INT AS periods,
    CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) AS maturity,
    cp AS current, CAST(b - cp + CASE WHEN o_orderkey % 11 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) AS noncurrent
  FROM (SELECT *, CAST(CAST(CAST(sign(o_orderkey % 7 - 1) AS BIGINT) * ((abs(CAST(b * 100 AS BIGINT) * (o_orderkey % 7 - 1)) * 2 + 5) // 10) AS DECIMAL(20,2)) / 100 AS DECIMAL(18,2)) AS cp
    FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS b FROM orders)))"""


def with_bank(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add `bank`: the nation of the obligation's customer."""
    banks = (
        read(spark, sf_dir, "customer")
        .join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
        .select(F.col("c_custkey").alias("custkey"), F.col("n_name").alias("bank"))
    )
    return rows.join(banks, "custkey")


BANKED = """banked AS (
  SELECT r.*, n_name AS bank FROM register r JOIN customer ON c_custkey = custkey JOIN nation ON n_nationkey = c_nationkey)"""
