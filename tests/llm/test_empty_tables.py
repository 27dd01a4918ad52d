"""Every registered corpus query, and the pipeline, on tables without rows and on tables of nulls."""

import importlib

import pytest

from ledgerbeam.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "conversations", "labels", "benchmark")


def tables(spark, folder, nulls):
    for t in TABLES:
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        some = spark.createDataFrame([(None,) * len(rows.columns)] * 3, rows.schema) if nulls else rows.where("false")
        some.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_and_null_tables(spark, tmp_path, name):
    empty = QUERIES[name](spark, tables(spark, tmp_path / "empty", False))
    want = 1 if name == "op6_format_chats" else 0
    assert empty.count() == want and empty.columns == QUERIES[name](spark, SF).columns
    of_nulls = QUERIES[name](spark, tables(spark, tmp_path / "nulls", True)).count()
    per_row = {"op4_nearest_vectors": 0, "op6_format_chats": 2, "op11_rank_documents": 0, "op13_repair_chats": 1}
    assert of_nulls == per_row.get(name, 3)


def test_pipeline_on_empty_and_null_tables(spark, tmp_path):
    run = importlib.import_module("corpus_pipeline").run
    assert run(spark, tables(spark, tmp_path / "empty", False)).count() == 0
    assert run(spark, tables(spark, tmp_path / "nulls", True)).count() >= 0
