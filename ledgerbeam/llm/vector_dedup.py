"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import cut, release, tasks
from ledgerbeam.llm.components import components
from ledgerbeam.llm.vectors import cosine, unit, usable

#: Buckets that a vector goes to in each table: its own and the likeliest others.
PROBES = 4
#: Codes of a table for each vector of the whole input, at least: folds are added until there are as many.
ROOM = 16
#: Folds of a code, at most.
MOST_FOLDS = 8
#: A pair right at the threshold meets in no table with this probability, about; tables are added until then.
MISSED = 1e-5
#: Rows of one bucket that one task holds against each other, at most about.
CAP = 2000
#: Runs of up to so many rows go pair by pair at equal distances, longer ones as products of matrices.
SHORT = 32
#: Products of unit vectors this near the threshold are taken again in the exact order.
EDGE = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two; orthonormal. Sixteen at a time."""
    n, d = x.shape
    step = 1
    while step < d:
        radix = min(16, d // step)
        small = np.array([[1.0]])
        while len(small) < radix:
            small = np.block([[small, small], [small, -small]])
        if step == 1:
            x = (x.reshape(-1, radix) @ small).reshape(n, d)
        else:
            x = np.matmul(small, x.reshape(-1, radix, step)).reshape(n, d)
        step *= radix
    return x / np.sqrt(d)


def folds_for(rows: int, dim: int) -> int:
    """Cross-polytope hashes in a code, so that a table has ROOM codes for each of `rows` vectors."""
    base = 2 * _width(dim)
    return min(MOST_FOLDS, max(2, math.ceil(math.log(max(2, ROOM * rows)) / math.log(base))))


def _width(dim: int) -> int:
    """Components of a padded vector: below sixteen there are too few different rotations by signs."""
    return max(16, 1 << (dim - 1).bit_length())


def codes(units: np.ndarray, tables: int, folds: int, seed: int = 5) -> np.ndarray:
    """(rows, tables, PROBES) codes: first the own bucket, then the likeliest neighbours.

    A rotation is three rounds of random signs and a Hadamard transform. The hash is the coordinate of largest
    size and its sign, the nearest vertex of the cross-polytope. Multiprobe: the second-nearest vertex in some
    of the folds, in order of how little nearer the nearest ones are in sum.
    """
    n, dim = units.shape
    width = _width(dim)
    padded = np.zeros((n, width))
    padded[:, :dim] = units
    rng = np.random.default_rng(seed)
    swaps = np.array(list(itertools.product((False, True), repeat=folds)))
    out = np.zeros((n, tables, PROBES), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        first, second, loss = (np.empty((n, folds), kind) for kind in (np.int64, np.int64, np.float64))
        for k in range(folds):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], width))
            size = np.abs(x)
            i = size.argmax(axis=1)
            top = size[rows, i]
            size[rows, i] = -1.0
            j = size.argmax(axis=1)
            first[:, k], second[:, k] = 2 * i + (x[rows, i] < 0), 2 * j + (x[rows, j] < 0)
            loss[:, k] = top - size[rows, j]
        order = np.argsort(loss @ swaps.T, axis=1, kind="stable")[:, :PROBES]
        for p in range(PROBES):
            chosen = np.where(swaps[order[:, p]], second, first)
            for k in range(folds):
                out[:, t, p] = out[:, t, p] * (2 * width) + chosen[:, k]
    return out


@lru_cache(maxsize=64)
def tables_for(dim: int, folds: int, least: float) -> int:
    """Tables after which a pair of cosine `least` is missed with probability MISSED: from pairs drawn at it."""
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 300, dim))
    a = unit(a)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    size = np.sqrt((b * b).sum(axis=1, keepdims=True))
    b = least * a + math.sqrt(max(0.0, 1.0 - least * least)) * np.divide(b, size, out=np.zeros_like(b), where=size > 1e-9)
    x, y = codes(a, 4, folds), codes(unit(b), 4, folds)
    met = (x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)
    p = min(max(met.mean() - 0.02, 0.05), 0.999)
    return math.ceil(math.log(MISSED) / math.log(1.0 - p))


def _mixed(label: np.ndarray, dim: int, found: np.ndarray) -> np.ndarray:
    """Bucket keys (rows, tables x PROBES) from label, length, table and code."""
    key = label[:, None].astype(np.uint64) ^ np.uint64(dim * 0x9E3779B97F4A7C15 % 2**64)
    for part in (np.repeat(np.arange(found.shape[1], dtype=np.uint64), PROBES)[None, :], found.reshape(len(found), -1).astype(np.uint64)):
        key = (key ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


class Forest:
    """Components of numbered rows under pairs that come in batches."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.up[i], self.up[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while len(i):
                higher = self.up[self.up]
                if (higher == self.up).all():
                    break
                self.up = higher


class Verifier:
    """Links among the rows of some buckets, whose vectors are of one length.

    A pair that meets in several buckets is counted in the first of them only: the lowest table, there the own
    bucket of the row of smaller node if that is shared. So rows of one own bucket in table 0 are compared
    there and nowhere else.
    """

    def __init__(self, pdf: pd.DataFrame, dim: int, least: float):
        pdf = pdf.sort_values(["key", "lo", "hi", "node"], kind="stable")
        self.least = least
        node, at, self.row = np.unique(pdf["node"].to_numpy(np.int64), return_index=True, return_inverse=True)
        one = pdf.iloc[at]
        self.node, self.weight = node, one["n"].to_numpy(np.float64)
        self.label = pd.factorize(one["label"])[0]
        self.data = np.frombuffer(b"".join(one["data"]), np.float64).reshape(-1, dim)
        self.keys = np.concatenate(one["keys"].to_list()).astype(np.int64).reshape(len(one), -1, PROBES)
        self.units = unit(self.data)
        self.linked = np.zeros(len(node))
        self.forest = Forest(len(node))
        self.key = pdf["key"].to_numpy(np.int64)
        self.block = pdf["block"].to_numpy(np.int64)
        lo, hi = pdf["lo"].to_numpy(np.int64), pdf["hi"].to_numpy(np.int64)
        self.crossing = lo != hi
        fresh = np.r_[True, (self.key[1:] != self.key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
        self.start = np.flatnonzero(fresh)
        self.length = np.diff(np.r_[self.start, len(fresh)])
        self.own = (self.keys[self.row, :, 0] == self.key[:, None]).any(axis=1)
        self.home = self.keys[self.row, 0, 0] == self.key

    def take(self, i: np.ndarray, j: np.ndarray) -> None:
        """Count those of the pairs (i, j) of rows, near by their products, that are links first met here."""
        x, y = np.minimum(self.row[i], self.row[j]), np.maximum(self.row[i], self.row[j])
        ok = (self.own[i] | self.own[j]) & (self.label[x] == self.label[y]) & (x != y)
        ok &= ~self.crossing[i] | (self.block[i] != self.block[j])
        same = self.keys[x, 0, 0] == self.keys[y, 0, 0]
        ok &= ~same | self.home[i]
        i, x, y, same = i[ok], x[ok], y[ok], same[ok]
        first = np.ones(len(x), bool)
        for s in range(0, len(x), 65536):
            some = s + np.flatnonzero(~same[s : s + 65536])
            kx, ky = self.keys[x[some]], self.keys[y[some]]
            x_in_y = (kx[:, :, :1] == ky).any(axis=2)
            y_in_x = (ky[:, :, :1] == kx).any(axis=2)
            table = (x_in_y | y_in_x).argmax(axis=1)
            at = np.arange(len(some))
            first[some] = np.where(x_in_y[at, table], kx[at, table, 0], ky[at, table, 0]) == self.key[i[some]]
        x, y = x[first], y[first]
        near = np.einsum("ij,ij->i", self.units[x], self.units[y])
        close = np.flatnonzero(np.abs(near - self.least) <= 2 * EDGE)  # only here rounding could decide
        linked = near >= self.least
        linked[close] = cosine(self.data[x[close]], self.data[y[close]]) >= self.least
        x, y = x[linked], y[linked]
        n = len(self.node)
        self.linked += np.bincount(x, self.weight[y], n) + np.bincount(y, self.weight[x], n)
        self.forest.join(x, y)

    def short(self) -> None:
        """All runs of few rows at once: each row with the next one, the one after that, and so on."""
        some = np.repeat(self.length <= SHORT, self.length)
        end = np.repeat(self.start + self.length, self.length)
        live = np.flatnonzero(some)
        for gap in range(1, SHORT):
            live = live[live + gap < end[live]]
            for s in range(0, len(live), 50_000):
                i = live[s : s + 50_000]
                j = i + gap
                near = np.einsum("ij,ij->i", self.units[self.row[i]], self.units[self.row[j]]) >= self.least - EDGE
                self.take(i[near], j[near])

    def core(self, run: np.ndarray) -> np.ndarray:
        """Rows of a run that lie so near a pivot that all of them are links of each other; counted without products."""
        home = run[self.home[run]]
        none = np.zeros(len(run), bool)
        if not len(home):
            return none
        pivot = self.row[home[0]]
        half = math.cos(math.acos(min(1.0, self.least)) / 2.0) + 1e-7
        inside = self.home[run] & (self.label[self.row[run]] == self.label[pivot])
        inside &= self.units[self.row[run]] @ self.units[pivot] >= half
        if inside.sum() < 3:
            return none
        at, block, w = self.row[run[inside]], self.block[run[inside]], self.weight[self.row[run[inside]]]
        if self.crossing[run[0]]:
            of = block == block[0]
            np.add.at(self.linked, at, np.where(of, w[~of].sum(), w[of].sum()))
            if of.all():
                return inside
        else:
            np.add.at(self.linked, at, w.sum() - w)
        self.forest.join(np.full(len(at) - 1, at[0]), at[1:])
        return inside

    def long(self) -> None:
        for s, n in zip(self.start[self.length > SHORT].tolist(), self.length[self.length > SHORT].tolist()):
            run = np.arange(s, s + n)
            core = self.core(run)
            run = np.r_[run[~core], run[core]]  # of the pairs, those within the core are settled
            others = self.units[self.row[run]]
            for a in range(0, n - int(core.sum()), 512):
                b = min(a + 512, n - int(core.sum()))
                i, j = np.nonzero(others[a:b] @ others[a:].T >= self.least - EDGE)
                later = i < j
                self.take(run[a + i[later]], run[a + j[later]])

    def found(self) -> pd.DataFrame:
        root = self.forest.up
        some = (self.linked > 0) | (root != np.arange(len(root)))
        return pd.DataFrame({"node": self.node[some], "other": self.node[root[some]], "n": self.linked[some].astype(np.int64)})


def _verified(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """(node, other, n): `n` vectors linked to `node` that are met first here; (node, other) join components."""
    out = [pd.DataFrame({"node": [], "other": [], "n": []}).astype("int64")]
    for dim, part in pdf.groupby("dim"):
        v = Verifier(part, int(dim), least)
        v.short()
        v.long()
        out.append(v.found())
    return pd.concat(out)


def hashed(classes: DataFrame, rows: int, least: float) -> DataFrame:
    """(node, label, n, dim, data, keys) for each class of equal vectors: its bytes and the keys of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index("embedding"))
            length = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            start = np.r_[0, np.cumsum(length)]
            mark = b.column(b.schema.get_field_index("mark")).to_numpy(zero_copy_only=False)
            for dim in np.unique(length).tolist():
                folds = folds_for(rows, dim)
                tables = tables_for(dim, folds, least)
                for at in np.array_split(own := np.flatnonzero(length == dim), -(-len(own) // 1000)):
                    data = values[start[at][:, None] + np.arange(dim)]
                    keys = _mixed(mark[at], dim, codes(unit(data), tables, folds))
                    kept = b.select(["node", "label", "n"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *kept.columns,
                            pa.array(np.full(len(at), dim, np.int32)),
                            pa.array([d.tobytes() for d in data], pa.binary()),
                            pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.reshape(-1)),
                        ],
                        ["node", "label", "n", "dim", "data", "keys"],
                    )

    given = classes.select("node", "label", "n", "embedding", F.xxhash64("label").alias("mark"))
    return given.mapInArrow(run, "node long, label string, n long, dim int, data binary, keys array<long>")


def _candidates(table: DataFrame, cap: int) -> DataFrame:
    """(node, key, block, lo, hi): rows of buckets that are the own one of a row and hold another, hot ones in pieces.

    Rows of a bucket with over `cap` are dealt into blocks by a hash, and each row goes to every pair of blocks
    that its own is in. Only numbers move here, not vectors.
    """
    entries = table.select("node", F.posexplode("keys").alias("pos", "key")).select("node", "key", (F.col("pos") % PROBES == 0).alias("own"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("own").alias("owned")).where("owned and rows > 1")
    blocks = buckets.select("key", F.ceil(F.col("rows") / cap).cast("int").alias("blocks"))
    dealt = entries.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least("block", other).alias("lo"), F.greatest("block", other).alias("hi")),
    )
    return dealt.select("node", "key", "block", F.inline(pieces))


def near_duplicates(vectors: DataFrame, least: float = 0.98, cap: int = CAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`.

    Rows link when their labels are equal and not null and their cosine, in doubles, is at least `least`.
    Candidates come from shared buckets of the hash tables and are verified, so no link is false; a pair right
    at the threshold is missed with a probability of about MISSED, nearer ones far less often. Folds grow with
    the table and tables with what folds lose, so buckets hold near vectors and few others at any size.
    Equal vectors of one label form a class that is compared once; vectors move to the tasks that compare them,
    and of a hot bucket those near its pivot count without products. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, and neither do vectors of different length. Rows of one
    vec_id count as one vector each for n_links and each get a row of the result, with their own links. An empty
    table gives an empty result. Other columns, whatever their names, are ignored.
    """
    given = vectors.select("vec_id", "embedding", "label")
    fine = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = given.where(fine).select(
        "vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    classes = cut(rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")))
    shared = classes.groupBy("node").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(F.col("node").alias("_shared"))
    several = not shared.isEmpty()
    if several:  # ids of several vectors: these classes go by a hash until the components are known
        given_id, other_id = F.col("node").alias("first"), F.xxhash64("label", "embedding")
        marked = classes.join(shared, F.col("node") == F.col("_shared"), "left")
        classes = cut(marked.select("label", "embedding", "n", given_id, F.when(F.col("_shared").isNull(), F.col("node")).otherwise(other_id).alias("node")))
    table = cut(hashed(classes, classes.count(), least))
    candidates = cut(_candidates(table, cap))
    groups = max(tasks(vectors.sparkSession), candidates.count() // 20_000)
    by = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(groups))
    found = cut(
        candidates.join(table, "node")
        .select("node", "key", "block", "lo", "hi", "label", "n", "dim", "data", "keys", by.alias("grp"))
        .groupBy("grp")
        .applyInPandas(lambda pdf: _verified(pdf, least), "node long, other long, n long")
    )
    release(table, candidates)
    links = found.groupBy("node").agg(F.sum("n").alias("others"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    if several:
        ends = classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
        least_id = ends.groupBy("root").agg(F.min("first").alias("least"))
        roots = ends.join(least_id, "root").select("node", F.col("least").alias("root"))
    members = rows.join(
        classes.withColumnRenamed("n", "alike"),
        (rows["label"] == classes["label"]) & (rows["embedding"] == classes["embedding"]),
    ).select("vec_id", "node", "alike")
    per_row = (
        members.join(links, "node", "left")
        .join(roots, "node", "left")
        .select(
            "vec_id",
            (F.col("alike") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("root", "node").alias("component_id"),
        )
    )
    rest = given.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return per_row.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_vector_dedup(spark, sf_dir):
    """Contract query: links and components of all vectors."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
