import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerbeam.llm import mixing


def brute_targets(sizes):
    """Shares by weight, the excess over twice a source's size given to the others again and again."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, free, goal = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return goal | share
        for s in over:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
            free.discard(s)
    return goal


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        source = rng.choice(["a"] * 6 + ["b", "c", "d", None])
        rows.append((i, " ".join("w" * rng.randint(1, 40)), source, "x"))
    rows += [(700, None, "a", "x"), (701, " \t", "b", "x"), (5, rows[5][1], rows[5][2], "x"), (5, rows[5][1], rows[5][2], "x"), (None, "q r", "empty", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")


def test_targets_draws_and_reruns(spark, docs):
    rows = mixing.draws(mixing.sized_rows(docs)).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * len(r["copies"])
        target[r["source"]] = r["target"]
        assert len(r["copies"]) <= 2
    want = brute_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in want)
    assert all(0 <= target[s] - taken[s] <= max(20, 0.02 * target[s]) for s in want)
    again = mixing.draws(mixing.sized_rows(docs.repartition(3))).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["nth"], [tuple(c) for c in r["copies"]])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_repeats_rows_with_all_columns(spark, docs):
    drawn = Counter()
    for r in mixing.draws(mixing.sized_rows(docs)).collect():
        drawn[r["doc_id"]] += len(r["copies"])
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_spot"]
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert got == Counter({k: v for k, v in drawn.items() if v})
    assert mixing.mix(docs.where("false")).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 37), (3, 0), (4, 5)], "source_no int, quota long")
    ends = {r["source_no"]: r["ends"] for r in mixing.splitting_tree(quotas, 8, 3).collect()}
    assert {k: v[-1] for k, v in ends.items()} == {1: 1000, 2: 37, 3: 0, 4: 5}
    totals = [sum(e[i] - (e[i - 1] if i else 0) for e in ends.values()) for i in range(8)]
    assert max(totals) - min(totals) <= 1


def test_hypergeometric_has_the_right_frequencies(spark):
    from math import comb

    n = 4000
    u = spark.range(n).select(((F.col("id") + 0.5) / n).alias("u"))
    h = u.select(mixing.hypergeometric(F.lit(60), F.lit(25), F.lit(20), F.col("u")).alias("h"))
    got = defaultdict(int, {r["h"]: r["count"] for r in h.groupBy("h").count().collect()})
    for k in range(21):
        assert abs(got[k] - n * comb(25, k) * comb(35, 20 - k) / comb(60, 20)) <= 2


def test_a_giant_document_leaves_no_gap(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(30, 50)), "a") for i in range(1500)] + [(i, "w " * 30_000, "a") for i in range(2000, 2003)]
    rows += [(3000 + i, "v " * 100, "b") for i in range(30)]
    for seed in (1, 20):
        drawn = mixing.draws(mixing.sized_rows(spark.createDataFrame(rows, "doc_id long, text string, source string")), seed=seed).collect()
        for source in "ab":
            own = [r for r in drawn if r["source"] == source]
            gap = own[0]["target"] - sum(r["size"] * len(r["copies"]) for r in own)
            least = min(len(r["copies"]) for r in own)
            assert gap >= 0 and not any(r["size"] <= gap for r in own if len(r["copies"]) == least and least < own[0]["target"] / own[0]["source_size"])
            spots = [tuple(c) for r in own for c in r["copies"]]
            assert len(spots) == len(set(spots))


def test_shards_hold_the_blocks_that_the_tree_gives_them(spark, docs):
    """Blocks by source and shard are the tree's quotas, and the query's columns follow them."""
    rows = mixing.draws(mixing.sized_rows(docs), shards=8).collect()
    drawn, by_shard = Counter(), defaultdict(Counter)
    for r in rows:
        for c in r["copies"]:
            drawn[r["source"]] += 1
            by_shard[r["source"]][c["shard"]] += 1
    names = sorted([s for s in drawn if s is not None]) + [None]
    quotas = spark.createDataFrame([(i, -(-drawn[s] // mixing.BLOCK)) for i, s in enumerate(names, 1)], "source_no int, quota long")
    ends = {r["source_no"]: r["ends"] for r in mixing.splitting_tree(quotas, 8, 20).collect()}
    for i, s in enumerate(names, 1):
        left = drawn[s]
        for shard in range(8):
            blocks = ends[i][shard] - (ends[i][shard - 1] if shard else 0)
            want = min(left, blocks * mixing.BLOCK)
            assert by_shard[s][shard] == want
            left -= want
    per_shard = [sum(-(-c[k] // mixing.BLOCK) for c in by_shard.values()) for k in range(8)]
    assert max(per_shard) - min(per_shard) <= 2 and sum(drawn.values()) > 300


def test_columns_named_like_the_new_ones_and_many_sources(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 150}", 1, 2) for i in range(900)] + [(1000, "w " * 5000, "s1", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_shard int, mix_spot int")
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_shard_", "mix_spot_"] and mixed.where("mix_shard <> 1").count() == 0
    assert mixed.select("mix_shard_").distinct().count() == 16
