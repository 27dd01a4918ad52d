"""Tables laid out for many sums over one key: bucketed and sorted by it, with texts in the form that criteria compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ends the name of a column that holds another one in capitals.
FOLDED = "_folded"


def save_bucketed(rows: DataFrame, table: str, key: str, buckets: int, texts: list[str] | None = None) -> DataFrame:
    """Write `rows` as table `table`, in `buckets` buckets by `key` and sorted by it within each; read it back.

    Tables with equal keys and buckets are joined, and summed by the key, without a shuffle. For each of `texts` a
    column in capitals is added, so that criteria on it, which do not tell case, reach the scan. A table of that name
    is replaced. The data are dealt out by key once, here, so that a bucket is one file.
    """
    spark: SparkSession = rows.sparkSession
    folded = [F.upper(c).alias(c + FOLDED) for c in texts or []]
    dealt = rows.select("*", *folded).repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def begins(column: str, prefix: str) -> Column:
    """The criterion `prefix*` on a column of a bucketed table, in a form that scans take over."""
    return F.col(column + FOLDED).startswith(prefix.upper())


def is_text(column: str, text: str) -> Column:
    """The criterion `text` on a column of a bucketed table."""
    return F.col(column + FOLDED) == text.upper()
