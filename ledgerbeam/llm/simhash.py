"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import by_text, cut, split_hot, tasks
from ledgerbeam.llm.components import components

#: (lowest bit, number of bits) of the three blocks of a fingerprint.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Bits of a block that a Hamming code covers; the others are taken as they are.
CODED = 15
#: Rows of one anchor that one task compares with each other, at most about.
CAP = 20_000


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a whole text; fewer words make one shingle, none makes none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint whose bits are set in over half of the hashes; 0 for none.

    Eight shifts bring each bit into a byte lane; up to 255 masked words add up without carry.
    """
    counts = np.zeros((8, 8), np.int64)
    lanes = np.uint64(0x0101010101010101)
    for shift in range(8):
        bits = (hashes >> np.uint64(shift)) & lanes
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255)) if len(bits) else bits
        counts[:, shift] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero((counts > len(hashes) / 2).reshape(-1))  # byte by byte, low bit first
    return int(sum(1 << int(b) for b in set_bits))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text as a signed long; null and empty texts get 0."""

    def make():
        return lambda texts: [np.array([majority(shingle_hashes(t, words)) for t in texts], np.uint64).view(np.int64)]

    return by_text(docs, ["doc_id"], "fp long", make)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, home) of every anchor that each fingerprint goes to.

    Two fingerprints within four bits differ in at most one bit of one of three blocks. A block's anchors are
    the words of a Hamming code over its first 15 bits, with any values in its other bits: a perfect code, so
    each fingerprint has one anchor, its home, within the covering radius of 1. It is copied to all anchors
    within radius plus threshold, 2, so that it meets each neighbour at the neighbour's home. Of the anchors
    that differ in an uncoded bit those suffice where the bit is cleared, as one of two neighbours has it set.
    """
    rows, keys, homes = [], [], []
    every = np.arange(len(fps))
    add = lambda r, k, h: (rows.append(r), keys.append(k), homes.append(np.full(len(r), h)))
    place = np.arange(1, CODED + 1)
    for no, (low, width) in enumerate(BLOCKS):
        block = ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        coded, rest = block & ((1 << CODED) - 1), block >> CODED
        syndrome = np.zeros(len(fps), np.int64)
        for p in place:
            syndrome ^= np.where((coded >> (p - 1)) & 1, p, 0)
        center = np.where(syndrome > 0, coded ^ (1 << np.maximum(syndrome - 1, 0)), coded)
        name = lambda c, r: (no << 40) | (r << CODED) | c  # noqa: B023, E731
        add(every, name(center, rest), True)
        for p in place:  # the words at distance two: flip two places whose numbers xor to the syndrome
            q = syndrome ^ p
            at = np.flatnonzero((syndrome > 0) & (q > p))
            add(at, name(coded[at] ^ (1 << (p - 1)) ^ (1 << (q[at] - 1)), rest[at]), False)
        for bit in range(width - CODED):
            at = np.flatnonzero((rest >> bit) & 1)
            add(at, name(center[at], rest[at] ^ (1 << bit)), False)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def spanning_links(fps: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of a set of fingerprints, found breadth first: at most one for each."""
    left = np.arange(len(fps))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left) > 1:
        seed, left, front = left[0], left[1:], left[:1]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 64):
                part = fps[front[i : i + 64], None] ^ fps[left][None, :]
                near |= (np.bitwise_count(part) <= within).any(axis=0)
            front, left = left[near], left[~near]
            a.append(np.full(len(front), seed))
            b.append(front)
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


def _links_in(pdf: pd.DataFrame, within: int) -> pd.DataFrame:
    """Links among the rows of many anchors: sorted by anchor, each row is held against the next ones of its run."""
    pdf = pdf.sort_values(["key", "lo", "hi"], kind="stable")
    fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    home, block = pdf["home"].to_numpy(bool), pdf["block"].to_numpy()
    keys = pdf[["key", "lo", "hi"]].to_numpy(np.int64)
    fresh = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)] if len(keys) else np.empty(0, bool)
    start = np.flatnonzero(fresh)
    length = np.diff(np.r_[start, len(fps)])
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    crossing = keys[start, 1] != keys[start, 2] if len(keys) else np.empty(0, bool)
    for s, n in zip(start[length > 256], length[length > 256]):
        x, y = spanning_links(fps[s : s + n], within)
        a.append(fps[s + x])
        b.append(fps[s + y])
    small = np.repeat((length <= 256), length)
    end = np.repeat(start + length, length)
    cross = np.repeat(crossing, length)
    live = np.flatnonzero(small)
    for gap in range(1, 256):
        live = live[live + gap < end[live]]
        if not len(live):
            break
        i, j = live, live + gap
        ok = (home[i] | home[j]) & (np.bitwise_count(fps[i] ^ fps[j]) <= within) & ~(cross[i] & (block[i] == block[j]))
        a.append(fps[i[ok]])
        b.append(fps[j[ok]])
    if not a:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    x, y = np.concatenate(a), np.concatenate(b)
    return pd.DataFrame({"a": np.minimum(x, y).view(np.int64), "b": np.maximum(x, y).view(np.int64)}).drop_duplicates()


def links(distinct: DataFrame, within: int = 4, cap: int = CAP) -> DataFrame:
    """(a, b): links whose components are those of all pairs of `fp` at most `within` (up to 4) bits apart."""
    if within > 4:
        raise ValueError("three blocks cover up to four differing bits")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            for i in range(0, len(fps), 20_000):
                part = fps[i : i + 20_000]
                row, key, home = anchors(part.view(np.uint64))
                yield pd.DataFrame({"key": key, "fp": part[row], "home": home})

    spark = distinct.sparkSession
    copies = distinct.select("fp").mapInPandas(spread, "key long, fp long, home boolean")
    dealt = split_hot(copies, "key", "fp", cap)
    # about 60,000 rows a group: some thirty copies of two thousand fingerprints
    groups = max(tasks(spark), distinct.count() // 2000)
    by = F.pmod(F.xxhash64("key", "piece.lo", "piece.hi"), F.lit(groups))
    rows = dealt.select("key", "fp", "home", "block", "piece.lo", "piece.hi", by.alias("grp"))
    return rows.groupBy("grp").applyInPandas(lambda pdf: _links_in(pdf, within), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, within: int = 4, cap: int = CAP) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`.

    Documents link when their fingerprints differ in `within` bits or fewer; component_id is the smallest
    doc_id reachable by links, null ids aside. Equal fingerprints are one node, so copies cost nothing more.
    Null and empty texts have fingerprint 0 and link like any other. Repeated rows each get their row; an empty
    table gives an empty result; other columns are ignored.
    """
    marked = cut(fingerprints(docs, words))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = cut(components(links(distinct, within, cap)))
    rooted = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_dedup(spark, sf_dir):
    """Contract query: fingerprint and component of every document, shingles of four words."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
