"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Folders that `cut` has written and nothing has deleted yet.
_WRITTEN: set[str] = set()

#: ASCII white space (tab to carriage return, and space) ends a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only on a single machine where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ledgerbeam-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends here.

    The files outlive lost executors, and Parquet keeps them smaller than a checkpoint. `release` deletes them
    once nothing reads them; those behind a result stay for as long as the result may be read, until `clear`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    _WRITTEN.add(path)
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from `cut` that no later work reads."""
    for t in tables:
        _delete(t.sparkSession, t.cut_path)


def clear(spark: SparkSession) -> None:
    """Delete all files that `cut` has left in this session, once its results have been used."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.discard(path)


def by_text(df: DataFrame, keep: list[str], added: str, make: Callable[[], Callable[[list], list]], rows: int = 2048) -> DataFrame:
    """The columns `keep` of `df` as they are, and those in the schema `added` that are made from `text`.

    `make` is called once in a task and gives a function from up to `rows` texts to lists, one for each added
    column. The other columns stay Arrow arrays, so whole numbers beside nulls keep every digit.
    """
    kept = StructType([df.schema[k] for k in keep])
    more = StructType.fromDDL(added)
    kinds = [to_arrow_type(f.dataType) for f in more]
    names = [*keep, *more.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for whole in batches:
            for b in (whole.slice(s, rows) for s in range(0, whole.num_rows, rows)):
                columns = find(b.column(len(keep)).to_pylist())
                made = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + made, names)

    return df.select(*[F.col(f"`{k}`") for k in keep], F.col("text")).mapInArrow(run, StructType([*kept, *more]))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores after it as it takes to clash with no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of white-space-separated words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tasks(spark: SparkSession) -> int:
    """Partitions that shuffles of this session use."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def split_hot(df: DataFrame, key: str, member: str, cap: int) -> DataFrame:
    """Add `piece` so that no (key, piece) holds much more than `cap` rows, and every pair still meets.

    Rows of a key with more than `cap` rows are dealt into blocks by a hash of `member`; each row goes to
    the pieces (its block, any other block), so the pairs of a hot key spread over many tasks. A piece is
    [lower block, higher block]; pairs within one block are wanted only where both are equal.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap)
    blocks = counts.select(key, F.ceil(F.col("_n") / cap).cast("int").alias("_blocks"))
    joined = df.join(blocks, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_blocks")).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda other: F.struct(F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi")),
    )
    return (
        joined.withColumn("block", own)
        .withColumn("piece", F.explode(pieces))
        .drop("_blocks")
    )
