"""SimHash near-dedup at a Jaccard similarity of word shingles: anchors and bands bring sets together, whole sets decide.

The anchors of `simhash` reach four differing bits, which pairs at 0.95 or more mostly keep to and pairs at 0.8, about
ten bits apart, hardly ever. So bands of least hashes bring the others together. Sketches of least hashes then tell
which sets may be alike at all; these make loose clusters. Whole sets are only made of members of clusters, each is
first held against one likely partner, and clusters that this leaves in several parts are worked through in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import cut, release, split_hot, tasks
from ledgerbeam.llm.components import components
from ledgerbeam.llm.simhash import links as anchor_links
from ledgerbeam.llm.simhash import majority, shingle_hashes

#: Bands of a sketch and least hashes in each: a pair at 0.8 meets in no band once in 20 million times.
BANDS, DEEP = 32, 4
#: Odd factors, each of which orders all hashes anew.
FACTORS = np.random.default_rng(8).integers(0, 2**63, BANDS * DEEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Least hashes that two sketches share: from LOOSE on sets belong to one cluster, from LIKELY on they may be copies.
#: Two sets at 0.8 share 102 of 128 on average, and under 76 once in 50 million times.
LOOSE, LIKELY = 58, 76
#: Texts that a task remembers as sketched already.
REMEMBERED = 200_000
#: Rows of one cluster that one task holds against each other, at most about; and bytes of sets that go to one task.
CAP, PIECE = 500, 4 << 20


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of all hashes in each of the orders of FACTORS."""
    least = np.full(BANDS * DEEP, 2**64 - 1, np.uint64)
    for s in range(0, len(hashes), 512):
        np.minimum(least, (hashes[s : s + 512, None] * FACTORS).min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band: sets that share a share J of their hashes agree on it with probability J ** DEEP."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, DEEP).T:
        key = (key ^ part) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _named(text: str | None, words: int) -> tuple[int, np.ndarray]:
    """The name of a text's shingle set, and the set, sorted."""
    h = np.unique(shingle_hashes(text, words))
    node = xxhash.xxh3_64_intdigest(h.tobytes(), 5)
    return node - (node >> 63 << 64), h


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, n, fp, keys, sketch): the shingle set of every whole text, named by its hash, and its SimHash.

    fp, keys (the bands) and sketch (16 bits of each least hash) are null where the task has given them for the same
    node. Null and empty texts have an empty set and no band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int16())]
        for batch in (whole.slice(s, 512) for whole in batches for s in range(0, whole.num_rows, 512)):
            rows = []
            for text in batch.column(1).to_pylist():
                node, h = _named(text, words)
                if node in seen:
                    rows.append((node, len(h), None, None, None))
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                fp, least = majority(h), least_hashes(h)
                sketch = (least >> np.uint64(40)).astype(np.uint16).view(np.int16)
                rows.append((node, len(h), fp - (fp >> 63 << 64), bands(least) if len(h) else None, sketch))
            made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "node", "n", "fp", "keys", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, n int, fp long, keys array<long>, sketch array<short>")


def _sets(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(node, n, hashes) of the nodes of `wanted` (doc_id, node): their texts are read again, and only theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(s, 128) for whole in batches for s in range(0, whole.num_rows, 128)):
            found = [_named(text, words) for text in batch.column(0).to_pylist()]
            made = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(h) for _, h in found], pa.int32()), pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, ["node", "n", "hashes"])

    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    made = texts.select("text").mapInArrow(run, "node long, n int, hashes array<long>")
    return cut(made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))


#: shared / (all - shared) >= 4 / 5, in whole numbers
ALIKE = "9 * shared >= 4 * (n_a + n_b)"


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have a Jaccard similarity of 0.8 or more, written out."""
    of = lambda end: sets.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("hashes").alias(f"of_{end}"))
    shared = F.size(F.array_intersect("of_a", "of_b")).alias("shared")
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "n_a", "n_b", shared)
    return cut(both.where(ALIKE).select("a", "b"))


def _by_anchors(marked: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints meet on an anchor within four bits, each fingerprint by its smallest set."""
    of = cut(marked.where("keys is not null").select("fp", "node").distinct())
    first = of.groupBy("fp").agg(F.min("node").alias("a"))
    same = of.join(first, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    ends = lambda fp, node: first.select(F.col("fp").alias(fp), F.col("a").alias(node))
    near = anchor_links(first.select("fp")).toDF("x", "y").join(ends("x", "p"), "x").join(ends("y", "q"), "y")
    found = cut(same.union(near.select(F.least("p", "q"), F.greatest("p", "q"))))
    release(of)
    return found


def _spanning(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join what belongs together in each piece of a cluster: no more than rows, however many pairs are alike.

    Pairs of different parts come with the likeliest first; those that are joined by then are not looked at.
    """
    a, b = [], []
    for _, rows in pdf.groupby(["cluster", "lo", "hi"], sort=False):
        nodes, sets = rows["node"].tolist(), rows["hashes"].tolist()
        sizes, sketches = rows["n"].to_numpy(np.int64), np.stack(rows["sketch"].to_list())
        root, up = {}, list(range(len(nodes)))

        def find(i, up=up):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i, r in enumerate(rows["root"].tolist()):
            up[i] = root.setdefault(r, i)
        parts = np.array([find(i) for i in range(len(nodes))])
        rated = []
        for i in range(len(nodes) - 1):
            other = np.flatnonzero((parts[i + 1 :] != parts[i]) & (5 * np.minimum(sizes[i], sizes[i + 1 :]) >= 4 * np.maximum(sizes[i], sizes[i + 1 :]))) + i + 1
            same = (sketches[other] == sketches[i]).sum(axis=1)
            rated += [(-int(n), i, int(j)) for n, j in zip(same, other) if n >= LIKELY]
        for _, i, j in sorted(rated):
            x, y = find(i), find(j)
            if x != y:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 9 * shared >= 4 * (sizes[i] + sizes[j]):
                    up[y] = x
                    a.append(nodes[i])
                    b.append(nodes[j])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def near_copies(docs: DataFrame, words: int = 5, cap: int = CAP) -> DataFrame:
    """(doc_id, node, component_id) for each row of `docs`.

    Documents link when the sets of their shingles of `words` words have a Jaccard similarity of 0.8 or more,
    counted on the whole sets; component_id is the smallest doc_id reachable by links, null ids aside. Equal
    sets are one node. Each set is rated by sketches against the smallest node of each of its bands; pairs that share
    LOOSE least hashes, and those that meet on an anchor, make clusters. The likeliest partner of each set is verified;
    clusters that are then in several parts are dealt in pieces, which are joined by verified links until no pair is
    left that might be alike. Null and empty texts are one node and link with nothing else; ids keep their type; an
    empty table gives an empty result; other columns, whatever their names, are ignored. A very long text is one task's.
    """
    marked = cut(sketches(docs, words))
    made = marked.where("keys is not null")
    spread = made.select("node", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a <> top").select("key", "a")
    star = spread.join(shared, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    drawn = cut(made.select("node", "n", "sketch").dropDuplicates(["node"]))
    of = lambda end: drawn.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"of_{end}"))
    same = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    rated = cut(star.join(of("b"), "b").join(of("a"), "a").select("a", "b", "n_a", "n_b", same.alias("same")).where(F.col("same") >= LOOSE))
    anchored = _by_anchors(marked)
    clusters = cut(components(rated.select("a", "b").union(anchored)))
    first = marked.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = _sets(docs, words, first.join(clusters.select("node"), "node", "left_semi"))
    likely = rated.where((F.col("same") >= LIKELY) & F.expr("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"))
    links = _verified(likely.groupBy("b").agg(F.max_by("a", F.struct("same", "a")).alias("a")), sets)
    roots = cut(components(links))
    parts = clusters.withColumnRenamed("root", "cluster").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = parts.groupBy("cluster").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    left = cut(parts.join(apart.select("cluster"), "cluster", "left_semi"))
    pieces = split_hot(left, "cluster", "node", cap).select("cluster", "node", "root", "piece.lo", "piece.hi")
    held = pieces.join(sets, "node").join(drawn.select("node", "sketch"), "node")
    size = left.join(sets.select("node", "n"), "node").agg(F.sum("n")).first()[0] or 0
    groups = max(tasks(docs.sparkSession), 8 * size // PIECE)
    dealt = held.withColumn("grp", F.pmod(F.xxhash64("cluster", "lo", "hi"), F.lit(groups)))
    more = cut(dealt.groupBy("grp").applyInPandas(_spanning, "a long, b long"))
    release(rated, anchored, clusters, sets, drawn, roots, left)
    joined = cut(components(links.union(more)))
    release(links, more)
    rooted = first.withColumnRenamed("doc_id", "first").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    return marked.select("doc_id", "node").join(named, "node").select("doc_id", "node", "component_id")
