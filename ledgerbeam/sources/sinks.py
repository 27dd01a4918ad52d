"""Results written out: tables with a manifest in order, and schedules as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def save_results(results: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each result as Parquet under `path`, and then a manifest (ord, name, rows, columns, folder), which is returned.

    Rows are counted by the write itself. Each run writes to a folder of its own, and the manifest, which says where a
    result is, comes last: a run that fails leaves the last complete one as it was. `load_results` reads by the manifest.
    """
    spark: SparkSession = next(iter(results.values())).sparkSession
    run, lines = uuid.uuid4().hex, []
    for i, (name, df) in enumerate(results.items()):
        seen = Observation(f"rows of {name}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/{run}/{name}")
        lines.append((i, name, seen.get["rows"], ", ".join(df.columns), run))
    manifest = spark.createDataFrame(lines, "ord int, name string, rows long, columns string, folder string")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest_table")
    return manifest


def load_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The results of the last complete run under `path`, in order; a manifest is as long as a report has tables."""
    lines = spark.read.parquet(f"{path}/_manifest_table").orderBy("ord").collect()
    return {r["name"]: spark.read.parquet(f"{path}/{r['folder']}/{r['name']}") for r in lines}


def schedules_json(nested: DataFrame) -> DataFrame:
    """(id, json): one document for each schedule, dates as ISO text, nulls left out."""
    return nested.select("id", F.to_json(F.struct(*[c for c in nested.columns if c != "id"]), {"dateFormat": "yyyy-MM-dd"}).alias("json"))


def schedule_summary(rows: DataFrame, cutoff) -> DataFrame:
    """For each schedule: rows, and period and balance of the last row dated up to the cut-off."""
    within = F.col("fecha") <= F.lit(cutoff)
    last = F.max_by(F.struct("per", "saldo_fin"), F.when(within, F.col("k")))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), last.alias("_l")).select(
        "id", "n_rows", F.col("_l.per").alias("last_period"), F.col("_l.saldo_fin").alias("balance")
    )
