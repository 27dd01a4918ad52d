"""Ranked search against scores of all documents, bounds that hold, and edge rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerbeam.llm import lexical_search as ls


def found_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(docs, items, top=50):
    """Sorted (item_id, doc_id, score) of the best documents, by scoring all of them."""
    counts = [(i, Counter(found_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(n_terms, 1)
            score = 0
            for t in set(found_terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, d if known else None, -s, r) for r, (s, known, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 30, 60, 400])))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(80)]  # ties over more than the top
    docs += [(7, docs[7][1]), (None, docs[7][1]), (None, None), (9001, None), (9002, ""), (9003, "... \x00\x7f"), (9004, "ÀÉ é K İ w1W2-w3\x0bw4"), (9005, "w5 " * 50_000 + "w399")]
    items = [(i, " ".join(rng.choices(words, k=20))) for i in range(30)]
    items += [(30, docs[7][1]), (31, None), (32, ""), (33, "nowhere at all"), (None, "w5 W5 w6"), (30, docs[7][1]), (34, "w0"), (35, "À é w1w2")]
    return docs, items


@pytest.mark.parametrize("block,widest", [(256, 21), (8, 21), (64, 7)])
def test_search_equals_scores_of_all(spark, monkeypatch, block, widest):
    monkeypatch.setattr(ls, "BLOCK", block)
    monkeypatch.setattr(ls, "WIDEST", widest)
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", F.lit(1)).withColumn("rank", F.lit("x")).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("nr", F.lit(1))
    got = sorted(map(tuple, ls.search(ls.build(d), i).collect()), key=str)
    assert got == plain(docs, items)


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ls, "QUERY_BYTES", 300)
    docs, items = corpus(200, 2)
    index = ls.build(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, ls.search(index, spark.createDataFrame(items, "item_id long, text string"), 5).collect()), key=str) == plain(docs, items, 5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ls.search(ls.build(none), asked).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert ls.search(ls.build(blank), asked).count() == 0
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ls.search(ls.build(some), asked.where("false")).count() == 0


def test_bounds_hold_and_leave_documents_out():
    docs, items = corpus(2000, 3)
    rows, waiting = [], defaultdict(list)
    df = Counter()
    for doc, text in docs:
        c = Counter(ls.terms((text or "").encode()))
        df.update(c.keys())
        words, counts = list(c), np.array(list(c.values()), np.int64)
        hashes = np.array([ls.xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        entries = sum(int((counts >= x).sum()) for x in ls.LEVELS)
        waiting[min(max(entries * ls.BITS - 1, 64).bit_length(), ls.WIDEST)].append((doc, sum(c.values()), words, counts, hashes))
    for width, held in waiting.items():
        rows += [ls._block(width, held[s : s + 64]) for s in range(0, len(held), 64)]
    queries = [sorted(set(ls.terms((t or "").encode()))) for _, t in items]
    n_docs, n_terms = sum(n > 0 for r in rows for n in r["sizes"]), sum(n for r in rows for n in r["sizes"])
    asked = {t for q in queries for t in q}
    scorer = ls.Scorer(queries, {t: n for t, n in df.items() if t in asked}, n_docs, n_terms, 10)
    for r in rows:
        m = 50 + (50 * np.array(r["sizes"]) * n_docs) // n_terms
        bounds = scorer.bounds(r["log_width"], r["slices"], len(m), m, np.array(r["most"]))
        for d in range(len(m)):
            held = dict(zip(r["terms"][d].split(b" "), np.frombuffer(r["counts"][d], np.uint32).tolist()))
            for k, i in enumerate(scorer.some):
                assert bounds[k, d] >= sum(w * ls.gain(held[t], int(m[d])) for t, w in scorer.queries[i] if t in held)
        scorer.take(r | {n: pa.array(r[n], pa.binary()) for n in ("terms", "counts")})
    assert scorer.scored < scorer.seen / 5
