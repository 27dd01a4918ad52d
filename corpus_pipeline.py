"""A training-data pipeline in stages, each of them one of the corpus operators.

Each stage takes (spark, docs, sf_dir), works on every document that the one before kept, and is written as
Parquet before the next one reads it. All of them take empty tables, which stay empty, null and empty texts, which
are neither toxic nor secret and encode to no ids, repeated rows, each of which counts, very long texts, which are
read whole, and further columns of any name, which come through as they are but for n_chars, which follows the text.
Stages that hand whole texts to Python lower the session's rows of an Arrow batch to BATCH, which changes no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerbeam.llm import mixing, near_copies, secrets, sentencepiece_scan, toxicity
from ledgerbeam.llm.common import cut

#: Rows that Spark hands to Python at a time, at most: the JVM and the worker both hold a batch of whole texts.
BATCH = 2048
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """From now on batches of at most BATCH rows; a smaller setting stays. Results are lazy, so it is not set back."""
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH:
        spark.conf.set(_ROWS, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned score does not reject, null and empty texts among them."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id; rows without an id stay.

    An id whose rows have several texts stays if one of them is the first of its group.
    """
    _small_batches(spark)
    found = near_copies.near_copies(docs)
    first = F.max(F.col("doc_id") == F.col("component_id"))
    others = found.where("doc_id is not null").groupBy("doc_id").agg(first.alias("first")).where("not first")
    return docs.join(others.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, rows and ids with their secrets masked; null texts stay null."""
    _small_batches(spark)
    return secrets.redact(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a row for each copy; null sources are one source."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and what they decode to; null and empty texts have none and decode to empty ones."""
    _small_batches(spark)
    found = sentencepiece_scan.encode(docs, digest=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Neither learned scores nor the seeded draws of the mix are SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
