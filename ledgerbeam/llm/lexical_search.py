"""Ranked lexical search over bit-sliced Bloom signatures, exact by rescoring.

The index is a table of blocks of documents. A document's signature holds its terms, and again those that it has at
least twice and at least four times; a block stores the signatures of its documents bit by bit, one bitmap over the
documents for each bit. For a query the bitmaps of a term's bits are joined by AND, weighted and summed: as a
signature never misses a term, this bounds every document's score from above. Only documents whose bound reaches the
score of the task's fiftieth document so far are scored exactly, from the lists of terms beside the signatures.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from ledgerbeam.llm.common import cut, table

#: ASCII letters and digits, and all that is not ASCII, make up terms; A-Z become a-z, and the rest of ASCII spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: A signature says whether a term occurs at least so often.
LEVELS = (1, 2, 4)

#: Bits of a term at a level, and bits of a signature for each entry; at most 2 ** WIDEST bits in all.
HASHES, BITS, WIDEST = 3, 10, 21

#: Documents of a block, and bits of all its signatures.
BLOCK, BLOCK_BITS = 128, 1 << 21

#: Texts that a task turns into Python objects at a time.
READ = 64

#: Bytes of queries that go to the tasks at once; further ones take another pass over the index.
QUERY_BYTES = 1 << 20

#: Odd factors of multiply-shift hashing, one for each level and hash, drawn by a fixed seed.
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, (len(LEVELS), HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

TOP = 50


def terms(text: bytes | None) -> list[bytes]:
    """All terms of a UTF-8 text in order; null has none."""
    return text.translate(FOLD).split() if text else []


def positions(hashes: np.ndarray, level: int, log_width: int) -> np.ndarray:
    """(terms, HASHES) bits of terms at a level in signatures of 2 ** log_width bits."""
    return ((hashes[:, None] * FACTORS[level]) >> np.uint64(64 - log_width)).astype(np.int64)


def _block(log_width: int, docs: list[tuple]) -> dict:
    """One row of the index from (doc_id, n, terms, counts, hashes)."""
    n = len(docs)
    bits = np.zeros((1 << log_width, -(-n // 8) * 8), bool)
    hashes = np.concatenate([d[4] for d in docs])
    counts = np.concatenate([d[3] for d in docs])
    owner = np.repeat(np.arange(n), [len(d[4]) for d in docs])
    for level, least in enumerate(LEVELS):
        held = counts >= least
        bits[positions(hashes[held], level, log_width), owner[held][:, None]] = True
    return {
        "log_width": log_width, "doc_ids": [d[0] for d in docs], "sizes": [d[1] for d in docs],
        "most": [int(d[3].max(initial=0)) for d in docs], "slices": np.packbits(bits, axis=1).tobytes(),
        "terms": [b" ".join(d[2]) for d in docs], "counts": [d[3].astype(np.uint32).tobytes() for d in docs],
    }


def build(docs: DataFrame) -> DataFrame:
    """The index of `docs` as a written table: no shuffle, one row for each block of documents of like length.

    Uses doc_id and text of every row; more columns are ignored. Null and empty texts have no terms and only count as
    rows. Repeated rows are documents of their own. Long texts are read whole and share a block with fewer others.
    """
    schema = StructType.fromDDL("log_width int, sizes array<long>, most array<int>, slices binary, terms array<binary>, counts array<binary>")
    schema = StructType([StructField("doc_ids", ArrayType(docs.schema["doc_id"].dataType)), *schema])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = defaultdict(list)

        def written(log_width):
            row = _block(log_width, waiting.pop(log_width))
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], k) for f, k in zip(schema, kinds)], schema.names)

        for b in (whole.slice(s, READ) for whole in batches for s in range(0, whole.num_rows, READ)):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                found = Counter(terms(text))
                words, counts = list(found), np.fromiter(found.values(), np.int64, len(found))
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                entries = sum(int((counts >= least).sum()) for least in LEVELS)
                log_width = min(max(entries * BITS - 1, 64).bit_length(), WIDEST)
                waiting[log_width].append((doc_id, int(counts.sum()), words, counts, hashes))
                if len(waiting[log_width]) >= max(8, min(BLOCK, BLOCK_BITS >> log_width)):
                    yield written(log_width)
        for log_width in list(waiting):
            yield written(log_width)

    return cut(docs.select("doc_id", "text").mapInArrow(run, schema))


def _counted(index: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each term of the queries occurs; counts meet map-side, one row for each term remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for b in batches:
            for i in range(b.num_rows):
                for joined in b.column(0)[i].as_py():
                    held.update(vocabulary.intersection(joined.split(b" ")))
        held.pop(b"", None)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

    found = index.select("terms").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in found.collect()}  # at most the terms of QUERY_BYTES


def gain(count, m):
    """What a term that occurs `count` times adds for each unit of its weight, in whole numbers."""
    return (1_000_000_000 * count) // (1000 * count + 20 * m)


class Scorer:
    """Weights of a block of queries, and the best documents of a task for each."""

    def __init__(self, queries: list[list[bytes]], df: dict[bytes, int], n_docs: int, n_terms: int, top: int):
        self.n_docs, self.n_terms, self.top = n_docs, n_terms, top
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        weight = {t: w for t, w in weight.items() if w > 0}
        self.queries = [[(t, weight[t]) for t in q if t in weight] for q in queries]
        self.words = sorted(weight)
        at = {t: i for i, t in enumerate(self.words)}
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.some = [i for i, q in enumerate(self.queries) if q]
        self.refs = np.array([at[t] for i in self.some for t, _ in self.queries[i]], np.int64)
        self.weights = np.array([w for i in self.some for _, w in self.queries[i]], np.float64)
        self.starts = np.cumsum([0, *[len(self.queries[i]) for i in self.some]])[:-1]
        self.best = [[] for _ in queries]  # (-score, id is there, id), least first
        self.floor = np.ones(len(queries), np.int64)  # a score has to be over 0
        self.scored = self.seen = 0

    def bounds(self, log_width: int, slices: bytes, n: int, m: np.ndarray, most: np.ndarray) -> np.ndarray:
        """(queries with terms, documents of the block): no score is greater."""
        maps = np.frombuffer(slices, np.uint8).reshape(1 << log_width, -1)
        total, below, present = np.zeros((len(self.some), n)), np.zeros(n, np.int64), None
        for level in range(len(LEVELS)):
            raw = np.bitwise_and.reduce(maps[positions(self.hashes, level, log_width)], axis=1)
            present = raw if present is None else present & raw
            upto = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else most
            here = gain(np.minimum(upto, np.maximum(most, 1)), m)
            held = np.flatnonzero(present.any(axis=1))
            if len(held):
                kept = np.isin(self.refs, held)
                rows = np.unpackbits(present[self.refs[kept]], axis=1, count=n) * self.weights[kept][:, None]
                owner = np.searchsorted(self.starts, np.flatnonzero(kept), side="right") - 1
                which, first = np.unique(owner, return_index=True)
                total[which] += np.add.reduceat(rows, first, axis=0) * np.maximum(here - below, 0)
            below = np.maximum(below, here)
        return total

    def take(self, block: dict) -> None:
        """Score those documents of a block that may be among the best of some query; terms and counts are Arrow arrays."""
        sizes, most = np.array(block["sizes"], np.int64), np.array(block["most"], np.int64)
        n = len(sizes)
        m = 50 + (50 * sizes * self.n_docs) // self.n_terms
        bounds = self.bounds(block["log_width"], block["slices"], n, m, most)
        self.seen += bounds.size
        lists: dict[int, dict] = {}
        for k in np.flatnonzero((bounds >= self.floor[self.some][:, None]).any(axis=1)):
            i = self.some[k]
            order = np.argsort(-bounds[k], kind="stable")
            for d in order:
                if bounds[k, d] < self.floor[i]:
                    break
                if d not in lists:
                    lists[d] = dict(zip(block["terms"][d].as_py().split(b" "), np.frombuffer(block["counts"][d].as_py(), np.uint32).tolist()))
                self.scored += 1
                held, size = lists[d], int(m[d])
                score = sum(w * gain(held[t], size) for t, w in self.queries[i] if t in held)
                if score >= self.floor[i]:
                    self._keep(i, score, block["doc_ids"][d])

    def _keep(self, i: int, score: int, doc_id) -> None:
        best = self.best[i]
        best.append((-score, doc_id is not None, doc_id if doc_id is not None else 0))
        if len(best) >= 2 * self.top:
            self._trim(i)

    def _trim(self, i: int) -> None:
        best = self.best[i]
        best.sort()
        del best[self.top :]
        if len(best) == self.top:
            self.floor[i] = -best[-1][0]


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, doc_id, score, rank) of the `top` documents of each row of `items` (item_id, text), over an index.

    Equal rows of `items` are one; rows of one item_id with several texts rank each on its own. Null texts and those
    whose terms no document holds find nothing. Ties go to the smaller doc_id, null first. Queries are taken in
    blocks of about QUERY_BYTES; for each the index is read twice, and a task hands over `top` rows for each query.
    """
    spark = index.sparkSession
    sizes = index.select(F.explode("sizes").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    asked = items.select("item_id", "text").where("text is not null").distinct()
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES))
    kind, doc_kind = items.schema["item_id"].dataType, index.schema["doc_ids"].dataType.elementType
    out = StructType([StructField("nr", StructType.fromDDL("nr int")["nr"].dataType), StructField("doc_id", doc_kind), *StructType.fromDDL("score long, rescored long, bounded long")])
    kinds = [to_arrow_type(f.dataType) for f in out]
    found = None
    for number in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        queries = [sorted(set(terms(r["text"].encode()))) for r in part]
        df = _counted(index, {t for q in queries for t in q})
        docs, total = sizes["docs"], sizes["terms"]

        def run(batches: Iterator[pa.RecordBatch], queries=queries, df=df, docs=docs, total=total) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(queries, df, docs, total, top)
            if scorer.some:
                for b in batches:
                    for i in range(b.num_rows):
                        row = {n: b.column(n)[i] for n in b.schema.names}
                        scorer.take({n: x.values if n in ("terms", "counts") else x.as_py() for n, x in row.items()})
            rows = []
            for i, best in enumerate(scorer.best):
                scorer._trim(i)
                rows += [(i, x[2] if x[1] else None, -x[0], scorer.scored, scorer.seen) for x in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], out.names)

        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)], StructType([out["nr"], StructField("item_id", kind)]))
        got = index.mapInArrow(run, out).join(F.broadcast(names), "nr").withColumn("block", F.lit(number))  # as many rows as queries in a block
        found = got if found is None else found.unionByName(got)
    order = W.partitionBy("block", "nr").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "doc_id", "score", "rank")


def op11_rank_documents(spark, sf_dir):
    """Contract query: the 50 highest-scoring documents of each benchmark item."""
    found = search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


ORACLE_OP11 = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS nr, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) FILTER (len(l) > 0) AS nn, sum(len(l))::BIGINT AS ll FROM t),
o AS (SELECT nr, term, count(*) AS tf FROM (SELECT nr, unnest(l) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM o, c GROUP BY 1),
s AS (SELECT item_id, nr, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(l) * nn) // ll))))::BIGINT AS score
  FROM q JOIN o USING (term) JOIN w USING (term) JOIN t USING (nr), c GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN t USING (nr) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 50
"""
