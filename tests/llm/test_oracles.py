"""Corpus queries against their SQL in DuckDB, and the shape of all of them."""

import duckdb
import pytest

from ledgerbeam.llm.oracles import ORACLES
from ledgerbeam.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = con.execute(ORACLES[name])
    at = [[c[0] for c in found.description].index(c) for c in names]
    want = sorted(tuple(r[i] for i in at) for r in found.fetchall())
    assert sorted(tuple(r) for r in df.select(*names).collect()) == want


@pytest.mark.parametrize("name", ["op1_score_toxicity", "op2_scan_secrets", "op3_sentencepiece", "op7_mix_sources", "op8_count_tokens", "op10_simhash_dedup", "op12_scan_licenses"])
def test_one_row_for_each_document(spark, name):
    ids = [r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_tokens_agree(spark):
    a = QUERIES["op3_sentencepiece"](spark, SF).select("doc_id", "n_tokens")
    b = QUERIES["op8_count_tokens"](spark, SF)
    assert a.exceptAll(b).count() == 0
