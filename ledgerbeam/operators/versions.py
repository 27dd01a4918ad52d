"""Differences of two large versions of a table: digests of buckets first, rows only where these differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbeam.operators.recon import version_diff

#: Buckets of each node of the tree, and its levels below the root: 64 * 64 leaves.
FAN, LEVELS = 64, 2


def bucket(key: list[str]) -> Column:
    """The leaf of a key."""
    return F.pmod(F.xxhash64(*key), F.lit(FAN**LEVELS)).cast("int")


def digests(rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(level, node, n, digest): a tree of digests, to be kept with a version of a table.

    A digest is a sum of two hashes of each row, so it does not depend on their order, and that of a node is the sum
    of its children's. Rows with equal keys and values count as often as they are there. One aggregation with at
    most FAN ** LEVELS groups; hashes tell versions apart but for chances of about 2 ** -64 a bucket.
    """
    parts = [F.col(c) for c in key + values]
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in key + values])
    hashed = lambda seed: F.xxhash64(F.lit(seed), nulls, *parts).cast("decimal(38,0)")
    leaves = rows.groupBy(bucket(key).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.sum(hashed(1)).alias("d1"), F.sum(hashed(2)).alias("d2"))
    nodes = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("leaf") / FAN ** (LEVELS - k)).cast("int").alias("node")) for k in range(LEVELS + 1)])
    tree = leaves.select(F.inline(nodes), "n", "d1", "d2").groupBy("level", "node").agg(F.sum("n").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"))
    return tree.select("level", "node", "n", F.struct("d1", "d2").alias("digest"))


def differing(a: DataFrame, b: DataFrame) -> list[int]:
    """The leaves in which two trees differ, found from the root down; at most FAN ** LEVELS numbers."""
    nodes = [0]
    for level in range(LEVELS + 1):
        of = lambda t, n: t.where((F.col("level") == level) & F.col("node").isin(nodes)).select("node", F.struct("n", "digest").alias(n))  # noqa: B023, E731
        both = of(a, "x").join(of(b, "y"), "node", "full").where(~F.col("x").eqNullSafe(F.col("y")))
        found = [r["node"] for r in both.select("node").collect()]
        if not found:
            return []
        nodes = [n * FAN + i for n in found for i in range(FAN)] if level < LEVELS else found
    return sorted(nodes)


def changes(a: DataFrame, b: DataFrame, key: list[str], values: list[str], trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """What `recon.version_diff` gives, for the rows that differ only.

    `trees` are the digests of both, if they have been kept: equal versions then compare without reading a row, and
    otherwise only buckets that differ are shuffled and joined. A value that is null in one version only differs.
    Keys are to be unique and not null.
    """
    first, second = trees or (digests(a, key, values), digests(b, key, values))
    leaves = differing(first, second)
    part = lambda df: df.where(bucket(key).isin(leaves) if leaves else F.lit(False))
    left, right = part(a).alias("l"), part(b).alias("r")
    differ = reduce(Column.__or__, [~F.col(f"l.{v}").eqNullSafe(F.col(f"r.{v}")) for v in values], F.lit(False))
    same = left.join(right, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in key]).where(~differ).select(*[F.col(f"l.{k}").alias(k) for k in key])
    return version_diff(part(a).join(same, key, "left_anti"), part(b).join(same, key, "left_anti"), key, values)
