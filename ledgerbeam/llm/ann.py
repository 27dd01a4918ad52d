"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Shards are regions: a vantage-point tree over a bounded sample of the vectors parts the space, every vector goes to the
leaf that it falls in, and a region with more of them than a tree should hold is dealt into pieces. Each piece gets its
tree once, written as arrays. A query knows from the sample how far its k-th neighbour is at most; by the triangle
inequality it leaves out the regions that lie farther, and in each tree the branches that do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerbeam.llm.common import cut, release, tasks
from ledgerbeam.llm.vectors import cosine, matrix, unit, usable

#: Bytes of the vectors of one tree, about, and vectors below which a table is not cut further for more tasks.
SHARD_BYTES, FEWEST = 16 << 20, 2048
#: Vectors that the regions are fitted on, the ones whose ids have the smallest hashes: at most so many, in at most so many bytes.
SAMPLE, SAMPLE_BYTES = 2048, 16 << 20
#: Regions of vectors of one length, at most; larger ones are dealt into pieces.
REGIONS = 64
#: Queries that walk a tree together, and those of one task.
BLOCK, SLAB = 1024, 16_384
#: Vectors in a leaf, compared directly.
LEAF = 128
#: Slack on distances while searching; results are then ranked by exact cosines.
SLACK = 1e-6

NODE = np.dtype([("vantage", "<i4"), ("radius", "<f8"), ("near", "<i4"), ("far", "<i4"), ("start", "<i4"), ("stop", "<i4")])


@dataclass
class Tree:
    """Nodes, the first of them the root, over the rows `order`. A node is a leaf, whose vantage is -1 and whose rows lie
    from start to stop, or it has a vantage row, a radius, the node of the rows within it and that of those beyond."""

    nodes: np.ndarray
    order: np.ndarray


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def build(units: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree over unit vectors under Euclidean distance, which orders as the cosine does and is a metric.

    The vantage point is the row farthest from the first one; the radius is the median distance from it.
    """
    order, nodes = np.array(rows), []

    def grow(a: int, b: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, a, b))
        own = order[a:b]
        if b - a <= leaf:
            return at
        vantage = own[np.argmin(units[own] @ units[own[0]])]
        rest = own[own != vantage]
        d = distance(units[rest], units[vantage][None, :])[:, 0]
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():
            return at
        order[a:b] = np.r_[vantage, rest[inside], rest[~inside]]
        middle = a + 1 + int(inside.sum())
        near = grow(a + 1, middle)
        nodes[at] = (vantage, radius, near, grow(middle, b), a, b)
        return at

    grow(0, len(order))
    return Tree(np.array(nodes, NODE), order)


class Regions:
    """The leaves of a tree over sampled vectors."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, regions: int):
        self.units, self.ids = unit(data), ids
        self.tree = build(self.units, np.arange(len(ids)), max(1, len(ids) // regions))

    def _from(self, at: int, x: np.ndarray) -> np.ndarray:
        return distance(x, self.units[self.tree.nodes[at]["vantage"]][None, :])[:, 0]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The region, a leaf's number, of each unit vector."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.tree.nodes[at]
            if node["vantage"] < 0:
                out[rows] = at
                continue
            inside = self._from(at, x[rows]) <= node["radius"]
            todo += [(int(node["near"]), rows[inside]), (int(node["far"]), rows[~inside])]
        return out

    def reach(self, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """How far the k-th neighbour of each query is at most: as far as the k-th in the sample."""
        d = distance(x, self.units)
        d[ids[:, None] == self.ids[None, :]] = np.inf
        return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(x), np.inf)

    def aim(self, x: np.ndarray, limit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(region, queries): the regions that may hold vectors within each query's limit."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.tree.nodes[at]
            if node["vantage"] < 0:
                yield at, rows
                continue
            gap = self._from(at, x[rows]) - node["radius"]
            todo += [(int(node["near"]), rows[gap <= limit[rows]]), (int(node["far"]), rows[-gap <= limit[rows]])]


class Search:
    """The k nearest rows of one tree for a block of queries, all queries walking the tree together."""

    def __init__(self, units: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float):
        self.units, self.ids, self.queries, self.query_ids, self.k, self.factor = units, ids, queries, query_ids, k, factor
        self.best = np.full((len(queries), k), np.inf)
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.compared = 0

    def offer(self, q: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        """Take the distances `d` of the queries `q` to `rows`: keep what may still be among the nearest."""
        self.compared += d.size
        d = np.where(self.query_ids[q][:, None] == self.ids[rows][None, :], np.inf, d)
        joined = np.concatenate([self.best[q], d], axis=1)
        self.best[q] = np.partition(joined, self.k - 1, axis=1)[:, : self.k]
        bound = self.best[q].max(axis=1, keepdims=True)
        i, j = np.nonzero((d <= bound + SLACK) & np.isfinite(d))
        self.pairs.append((q[i], rows[j], d[i, j]))

    def walk(self, tree: Tree, q: np.ndarray, at: int = 0) -> None:
        """A subtree is left out for a query if the triangle inequality puts it beyond factor times its bound."""
        if not len(q):
            return
        node = tree.nodes[at]
        if node["vantage"] < 0:
            rows = tree.order[node["start"] : node["stop"]]
            self.offer(q, rows, distance(self.queries[q], self.units[rows]))
            return
        vantage = np.array([node["vantage"]])
        d = distance(self.queries[q], self.units[vantage])
        self.offer(q, vantage, d)
        gap = d[:, 0] - node["radius"]
        for first, second, own, beyond in (("near", "far", gap <= 0, -gap), ("far", "near", gap > 0, gap)):
            self.walk(tree, q[own], int(node[first]))
            bound = self.best[q[own]].max(axis=1)
            self.walk(tree, q[own][beyond[own] <= bound * self.factor + SLACK], int(node[second]))

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs that may be among the k nearest, ties and rounding left in."""
        if not self.pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, r, d = (np.concatenate(x) for x in zip(*self.pairs))
        keep = d <= self.best[q].max(axis=1) + SLACK
        return q[keep], r[keep]


def _top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, by score downward, then by id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[place < k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest cosine for each query, but the query itself.

    Both inputs have vec_id and embedding; further columns, whatever their names, are ignored. A shard holds about
    `shard` vectors, by default what SHARD_BYTES hold; `block` queries walk a tree together. With `factor` 1 pruning is
    exact; below it regions and subtrees are dropped sooner, and recall falls. Ties go to the smaller vec_id.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, on either side; only
    vectors of equal length are compared. Rows with equal vec_id and embedding count once; an id of several
    vectors is several candidates, and a query for each of them, whose results are ranked together. An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    )
    # of equal vectors only the k + 1 with the smallest ids can be among anyone's k nearest
    same = W.partitionBy("embedding").orderBy("vec_id")
    rows = cut(clean(vectors).withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1).drop("nth"))
    counts = {r["dim"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    widest = max(counts, default=1)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(64, min(SAMPLE, SAMPLE_BYTES // (8 * widest)))).collect()
    per_shard = lambda dim: shard or max(1, SHARD_BYTES // (8 * dim))
    wanted = lambda dim: min(REGIONS, max(-(-counts[dim] // per_shard(dim)), min(tasks(spark), counts[dim] // FEWEST)))
    known: dict[int, dict] = {}
    for r in some:
        known.setdefault(len(r["embedding"]), {})[r["vec_id"], tuple(r["embedding"])] = None
    fitted = {d: Regions(np.array([v for _, v in own]), np.array([i for i, _ in own], np.int64), max(1, wanted(d))) for d, own in known.items()}
    regions = spark.sparkContext.broadcast(fitted)  # no more than the sample

    def by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for dim, part in pdf.groupby(pdf["embedding"].map(len)):
            yield int(dim), part["vec_id"].to_numpy(np.int64), matrix(part["embedding"])

    def table(dim: int, region, ids: np.ndarray, data: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"dim": np.int32(dim), "region": region, "vec_id": ids, "data": [d.tobytes() for d in data]})

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, ids, data in by_length(pdf):
                found = regions.value.get(dim)
                yield table(dim, found.place(unit(data)) if found else 0, ids, data)

    def aimed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, ids, data in by_length(pdf):
                found = regions.value.get(dim)
                if found is None:  # too few of this length for the sample: one region
                    yield table(dim, 0, ids, data)
                    continue
                for s in range(0, len(ids), BLOCK):
                    x, own, raw = unit(data[s : s + BLOCK]), ids[s : s + BLOCK], data[s : s + BLOCK]
                    for region, at in found.aim(x, found.reach(x, own, k) * factor + SLACK):
                        yield table(dim, region, own[at], raw[at])

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["vec_id", "data"]).sort_values("vec_id")
        data = np.frombuffer(b"".join(pdf["data"]), np.float64).reshape(len(pdf), -1)
        tree = build(unit(data), np.arange(len(pdf)))
        ids = pdf["vec_id"].to_numpy(np.int64)
        return pdf[["dim", "region", "piece"]].iloc[:1].assign(ids=ids.tobytes(), data=data.tobytes(), nodes=tree.nodes.tobytes(), rows=tree.order.astype(np.int32).tobytes())

    kind = "dim int, region int, vec_id long, data binary"
    homes = cut(rows.mapInPandas(placed, kind))
    asked = cut(clean(queries).distinct().mapInPandas(aimed, kind))
    # one row for each region of each length: pieces of its vectors, slabs of its queries
    size = lambda df, n: df.groupBy("dim", "region").agg(F.count(F.lit(1)).alias(n))
    wide = F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))) if shard is None else F.lit(shard)
    sizes = cut(
        size(homes, "n").join(size(asked, "m"), ["dim", "region"]).select(
            "dim", "region", F.ceil(F.col("n") / wide).cast("int").alias("pieces"), F.ceil(F.col("m") / SLAB).cast("int").alias("slabs")
        )
    )
    deal = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ("dim", "region", "piece")
    shards = cut(
        homes.join(F.broadcast(sizes), ["dim", "region"])  # at most REGIONS rows for each length
        .select("dim", "region", deal("pieces").alias("piece"), "vec_id", "data")
        .groupBy(*key)
        .applyInPandas(packed, "dim int, region int, piece int, ids binary, data binary, nodes binary, rows binary")
    )
    trees = shards.join(F.broadcast(sizes), ["dim", "region"]).select(*key, every("slabs").alias("slab"), "ids", "data", "nodes", "rows")
    sent = asked.join(F.broadcast(sizes), ["dim", "region"]).select("dim", "region", every("pieces").alias("piece"), deal("slabs").alias("slab"), "vec_id", "data")

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            own = left.iloc[0]
            ids = np.frombuffer(own["ids"], np.int64)
            data = np.frombuffer(own["data"], np.float64).reshape(len(ids), -1)
            tree, units = Tree(np.frombuffer(own["nodes"], NODE), np.frombuffer(own["rows"], np.int32)), unit(data)
            for s in range(0, len(right), block):
                part = right.iloc[s : s + block]
                qids = part["vec_id"].to_numpy(np.int64)
                given = np.frombuffer(b"".join(part["data"]), np.float64).reshape(len(part), -1)
                run = Search(units, ids, unit(given), qids, k, factor)
                run.walk(tree, np.arange(len(qids)))
                q, r = run.found()
                score = cosine(given[q], data[r])
                top = _top(q, ids[r], score, k)
                out.append(pd.DataFrame({"query_id": qids[q[top]], "vec_id": ids[r[top]], "score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    met = (*key, "slab")
    partial = trees.groupBy(*met).cogroup(sent.groupBy(*met)).applyInPandas(look, "query_id long, vec_id long, score double")
    release(rows, homes)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_nearest_vectors(spark, sf_dir):
    """Contract query: the five nearest vectors of every fiftieth, exactly (factor one)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, 1.0)
