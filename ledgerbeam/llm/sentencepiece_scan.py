"""SentencePiece encoding and decoding; giant documents by a parallel max-plus scan."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerbeam.llm import unigram
from ledgerbeam.llm.common import by_text, cut, tasks
from ledgerbeam.llm.unigram import (
    NONE,
    PRE_TOKEN,
    SPACE,
    Pieces,
    Remembered,
    core_length,
    encode_pre_token,
    forward,
    ids_of,
    normalize,
    path,
)

#: Rows that a worker hands back at a time.
ROWS = 512
#: Characters of a chunk. Texts of up to two chunks are encoded whole.
CHUNK = 32_768
#: Chunks of a run, whose matrices one task multiplies.
RUN = 64


class Chunk:
    """Characters [0, n) of a chunk, and up to longest-1 more that pieces begun in it may cover.

    State o at a boundary says that the first piece end at or after it lies o characters past it. Between the
    first and the last forced cut (a space after another character, which no piece spans) pre-tokens are
    independent, so only the stretches before and after need the dynamic program over states.
    """

    def __init__(self, m: Pieces, text: str, n: int):
        self.m, self.text, self.n = m, text, n
        cuts = [i for i in (self._first(), self._last()) if i is not None]
        self.first, self.last = (cuts[0], cuts[-1]) if cuts else (None, None)

    def _first(self) -> int | None:
        for i in range(1, self.n):
            if self.text[i] == SPACE and self.text[i - 1] != SPACE:
                return i
        return None

    def _last(self) -> int | None:
        for i in range(self.n - 1, 0, -1):
            if self.text[i] == SPACE and self.text[i - 1] != SPACE:
                return i
        return None

    def _exits(self, best: list[float], base: int) -> list[float]:
        w = self.m.longest
        return [best[self.n - base + o] if self.n + o <= len(self.text) else NONE for o in range(w)]

    def _middle(self) -> float:
        total = 0.0
        for t in PRE_TOKEN.findall(self.text[self.first : self.last]):
            best, _ = forward(self.m, t, [0.0], len(t))
            total += best[-1]
        return total

    def transfer(self) -> np.ndarray:
        """Scores from each entry state to each exit state."""
        w = self.m.longest
        out = np.full((w, w), NONE)
        units = [[NONE] * i + [0.0] for i in range(min(w, len(self.text) + 1))]
        if self.first is None:
            for i, unit in enumerate(units):
                best, _ = forward(self.m, self.text, unit, self.n)
                out[i] = self._exits(best, 0)
            return out
        head = np.full(w, NONE)
        for i, unit in enumerate(units):
            if i <= self.first:
                head[i] = forward(self.m, self.text[: self.first], unit, self.first)[0][-1]
        tail, _ = forward(self.m, self.text[self.last :], [0.0], self.n - self.last)
        return head[:, None] + (self._middle() + np.array(self._exits(tail, self.last)))[None, :]

    def _stretch(self, entry: list[float]) -> tuple[list[float], list[int]]:
        stop = self.n if self.first is None else self.first
        text = self.text if self.first is None else self.text[: self.first]
        return forward(self.m, text, entry[: len(text) + 1], stop)

    def entered(self, entry: list[float]) -> list[int]:
        """For each exit state, the entry state that the best path to it comes from; 0 where no path leads to it."""
        w = self.m.longest
        _, back = self._stretch(entry)
        if self.first is None:
            places = [path(back, self.n + o)[0] if self.n + o <= len(self.text) else 0 for o in range(w)]
            return [p if p < w else 0 for p in places]
        return [path(back, self.first)[0]] * w

    def trace(self, entry: list[float], leave: int) -> list[int]:
        """Ids of the best path, given the scores of the entry states and the exit state."""
        _, back = self._stretch(entry)
        if self.first is None:
            return self._spell(path(back, self.n + leave), 0)
        ids = self._spell(path(back, self.first), 0)
        for t in PRE_TOKEN.findall(self.text[self.first : self.last]):
            ids.extend(encode_pre_token(self.m, t))
        rest = self.text[self.last :]
        _, back = forward(self.m, rest, [0.0], self.n - self.last)
        return ids + self._spell(path(back, self.n - self.last + leave), self.last)

    def _spell(self, places: list[int], base: int) -> list[int]:
        t = self.text
        return [i for a, b in zip(places, places[1:]) for i in ids_of(self.m, t[base + a : base + b])]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product: best way through both."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def chain_of_maps(maps: list[np.ndarray]) -> np.ndarray:
    """One map of states for several in a row, the last applied first: from the exit state to the entry state."""
    out = np.arange(len(maps[0]))
    for come in reversed(maps):
        out = come[out]
    return out


def _chunks(docs: DataFrame, w: int, chunk: int) -> DataFrame:
    """(row, no, run, part, n): the normalized text in chunks, each with what pieces begun in it may reach into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(*(c.to_pylist() for c in b.columns)):
                t = normalize(text)
                for s in range(0, len(t), 64 * chunk):
                    at = range(s, min(len(t), s + 64 * chunk), chunk)
                    made = ([row] * len(at), [a // chunk for a in at], [a // chunk // RUN for a in at], [t[a : a + chunk + w - 1] for a in at], [min(chunk, len(t) - a) for a in at])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()))], ["row", "no", "run", "part", "n"])

    return docs.select("row", "text").mapInArrow(run, "row string, no long, run long, part string, n int")


def _long_texts(docs: DataFrame, pieces: Pieces, shared, chunk: int) -> DataFrame:
    """(row, ids) of texts that are cut into chunks.

    The scan has two levels: the matrices of a run of chunks give one product, the products of a text's runs give the
    states at the start of each run, and from there each run scans its own chunks. Exit states come back the same
    way, as maps of states.
    """
    w = pieces.longest

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(m=[Chunk(shared.value, t, n).transfer().tobytes() for t, n in zip(b["part"], b["n"])])

    square = lambda m: np.frombuffer(m).reshape(w, w)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = reduce(max_plus, map(square, pdf.sort_values("no")["m"]))
        return pdf[["row", "run"]].iloc[:1].assign(m=whole.tobytes())

    def scan(pdf: pd.DataFrame, state: np.ndarray) -> list[bytes]:
        """The scores of the states before each matrix, given those before the first."""
        out = []
        for m in pdf["m"]:
            out.append(state.tobytes())
            state = max_plus(state, square(m))
        return out

    def over_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        begin = np.full((1, w), NONE)
        begin[0, 0] = 0.0
        return pdf[["row", "run"]].assign(begin=scan(pdf, begin))

    def in_run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        return pdf[["row", "no"]].assign(entry=scan(pdf, np.frombuffer(pdf["begin"].iloc[0]).reshape(1, w)))

    def sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [Chunk(shared.value, t, n).entered(np.frombuffer(e).tolist()) for t, n, e in zip(b["part"], b["n"], b["entry"])]
            yield b[["row", "no", "run"]].assign(come=[np.array(x, np.int64).tobytes() for x in found])

    states = lambda come: np.frombuffer(come, np.int64)

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = chain_of_maps(list(map(states, pdf.sort_values("no")["come"])))
        return pdf[["row", "run"]].iloc[:1].assign(come=whole.tobytes())

    def leaving(pdf: pd.DataFrame, state: int) -> list[int]:
        """The exit state of each map, last to first, given that of the last."""
        out = []
        for come in pdf["come"]:
            out.append(state)
            state = int(states(come)[state])
        return out

    def runs_left(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run", ascending=False)
        return pdf[["row", "run"]].assign(end=leaving(pdf, 0))

    def chunks_left(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no", ascending=False)
        return pdf[["row", "no"]].assign(leave=leaving(pdf, int(pdf["end"].iloc[0])))

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [
                Chunk(shared.value, t, n).trace(np.frombuffer(e).tolist(), o)
                for t, n, e, o in zip(b["part"], b["n"], b["entry"], b["leave"])
            ]
            yield b[["row", "no"]].assign(ids=found)

    key, runs = ["row", "no"], ["row", "run"]
    dealt = _chunks(docs, w, chunk).repartition(tasks(docs.sparkSession), *key)
    table = cut(dealt.mapInPandas(matrices, "row string, no long, run long, part string, n int, m binary"))
    products = table.select("row", "no", "run", "m").groupBy(*runs).applyInPandas(product, "row string, run long, m binary")
    begins = products.groupBy("row").applyInPandas(over_runs, "row string, run long, begin binary")
    entries = table.select("row", "no", "run", "m").join(begins, runs).groupBy(*runs).applyInPandas(in_run, "row string, no long, entry binary")
    ready = cut(table.select("row", "no", "run", "part", "n").join(entries, key))
    come = cut(ready.mapInPandas(sources, "row string, no long, run long, come binary"))
    ends = come.groupBy(*runs).applyInPandas(composed, "row string, run long, come binary").groupBy("row").applyInPandas(runs_left, "row string, run long, end int")
    exits = come.join(ends, runs).groupBy(*runs).applyInPandas(chunks_left, "row string, no long, leave int")
    ids = ready.join(exits, key).mapInPandas(traced, "row string, no long, ids array<int>")
    return ids.groupBy("row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids")
    )


def _packer(m: Pieces) -> Remembered:
    """Ids of pre-tokens as bytes; one cache for a worker's whole life. A word is looked up apart from the signs after it."""
    found = m.__dict__.get("packer")
    if found is None:

        def make(token: str) -> bytes:
            n = core_length(m, token)
            if n < len(token):
                return b"".join(map(found.__getitem__, (token[:n], *token[n:])))
            return array("i", encode_pre_token(m, token)).tobytes()

        found = m.packer = Remembered(make)
    return found


def encode(docs: DataFrame, model: str = unigram.DEFAULT_MODEL, chunk: int = CHUNK, decoded: bool = False, digest: bool = False) -> DataFrame:
    """(doc_id, ids) for each row: the best segmentation of every whole text, as piece ids.

    A text of over two chunks is cut. Its chunks give transfer matrices between boundary states, which max-plus
    products combine, runs of chunks first; the scores at each boundary then let every chunk name the state it is
    entered by, and, these composed from the end, trace its own piece of the one best path. A run sends 2 KB for each
    of its chunks to one task, a text 2 KB for each of its runs. Segmentations are the same on either side of two
    chunks; scores that are no whole numbers may round differently there, which could tell only between equals.
    Null and empty texts have no ids; repeated rows each keep their row, ids of rows their type; an empty table gives
    an empty result; other columns, whatever their names, are ignored. With `decoded` a third column holds the text
    that the ids decode to; with `digest` instead, `decoded_sha256` holds its SHA-256, so that no text comes back.
    """
    pieces = unigram.load(model)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    given = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text") > 2 * chunk, F.lit(False))

    def make():
        m = shared.value
        pack = _packer(m).__getitem__

        def find(texts: list) -> list[pa.Array]:
            packed = [b"".join(map(pack, PRE_TOKEN.findall(normalize(t)))) if t else b"" for t in texts]
            flat = np.frombuffer(b"".join(packed), "<i4")
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            found = [pa.ListArray.from_arrays(ends, flat)]
            if decoded or digest:
                flat = flat.tolist()
                back = (unigram.decode(m, flat[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist()))
                found.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back] if digest else list(back), pa.string()))
            return found

        return find

    short = by_text(given.where(~is_long), ["doc_id"], "ids array<int>" + (", decoded_sha256 string" if digest else ", text string" if decoded else ""), make, ROWS)
    # equal texts have equal ids, so a digest of the text can stand for the row
    giant = given.where(is_long).withColumn("row", F.sha2("text", 256))
    found = _long_texts(giant.dropDuplicates(["row"]), pieces, shared, chunk)
    long = giant.select("doc_id", "row").join(found, "row").select("doc_id", "ids")
    if digest:
        return short.unionByName(decode(long, model).select("doc_id", "ids", F.sha2("text", 256).alias("decoded_sha256")))
    return short.unionByName(decode(long, model) if decoded else long)


def decode(encoded: DataFrame, model: str = unigram.DEFAULT_MODEL) -> DataFrame:
    """The rows of `encoded`, all columns as they are, with `text` decoded from `ids`; null ids give null, none an empty text.

    A column `text` that is there already is replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(unigram.load(model))
    kept = encoded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids")).to_pylist()
            text = pa.array([None if i is None else unigram.decode(shared.value, i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, "text"])

    return kept.mapInArrow(run, StructType([*kept.schema, StructField("text", StringType())]))


def op3_sentencepiece(spark, sf_dir):
    """Query: tokens of every document, a digest of its ids, and the digest of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = encode(docs, decoded=True)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.length("text").cast("long").alias("decoded_chars"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


