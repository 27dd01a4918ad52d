import numpy as np
import pytest

from ledgerbeam.llm import ann, vector_dedup
from ledgerbeam.llm.vectors import cosine, unit


def sample(n=400, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 2, dim))
    near = base[rng.integers(0, 20, n - n // 2)] + rng.normal(scale=0.05, size=(n - n // 2, dim))
    x = np.concatenate([base, near]).astype(np.float32).astype(float)
    x[30] = x[31] = x[7]
    return x


def frame(spark, x, ids=None, labels=None, extra=()):
    rows = [(i, [float(c) for c in v], lab) for i, v, lab in zip(ids or range(len(x)), x, labels or [i % 3 for i in range(len(x))])]
    return spark.createDataFrame(rows + list(extra), "vec_id long, embedding array<double>, label int")


ODD = [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [1.0, 2.0], 0), (1004, [None] * 24, 1), (1005, [], 2)]


@pytest.mark.parametrize("shard,block", [(4096, 1024), (90, 3)])
def test_search_is_exact_at_factor_one(spark, shard, block):
    x = sample()
    df = frame(spark, x, extra=ODD)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 10 = 0"), 5, 1.0, shard, block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 10))
    for q, found in got.items():
        s = cosine(np.repeat(x[q : q + 1], 400, axis=0), x)
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:5]
        assert found == [(i, s[i]) for i in order]


def test_pruning_leaves_work_out_and_a_small_factor_more():
    x = unit(sample(3000, 6, 3))
    ids = np.arange(len(x))
    tree = ann.build(x, ids)
    done = []
    for factor in (1.0, 0.5):
        s = ann.Search(x, ids, x[:50], ids[:50], 5, factor)
        s.walk(tree, np.arange(50))
        done.append(s.compared)
    assert done[1] < done[0] < 50 * 3000


def test_fewer_candidates_than_k(spark):
    df = frame(spark, sample()[:3])
    rows = ann.nearest(df, df.where("vec_id = 0"), 5).collect()
    assert [r["rank"] for r in rows] == [1, 2]
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def brute(x, labels, least=0.98):
    n = len(x)
    link = [[labels[i] == labels[j] and i != j and cosine(x[i : i + 1], x[j : j + 1])[0] >= least for j in range(n)] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i]] + [comp[j] for j in range(n) if link[i][j]]) for i in range(n)]
        if new == comp:
            break
        comp = new
    return [sum(r) for r in link], comp


@pytest.mark.parametrize("cap", [4000, 5])
def test_dedup_matches_brute_force(spark, cap):
    x = sample(160, 24, 5)
    labels = [0 if i < 120 else 1 for i in range(160)]
    df = frame(spark, x, labels=labels, extra=ODD + [(1006, [1.0] * 24, None)])
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(df, cap=cap).collect()}
    n, comp = brute(x, labels)
    assert sum(n) > 100
    assert [got[i]["n_links"] for i in range(160)] == n
    assert [got[i]["component_id"] for i in range(160)] == comp
    assert all(got[i]["kept"] == (comp[i] == i) for i in range(160))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(1000, 1007))
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(4, 8))
    assert np.allclose((vector_dedup.hadamard(x) ** 2).sum(axis=1), (x**2).sum(axis=1))


@pytest.mark.parametrize("dim", [2, 8, 24, 64, 384, 768])
def test_pairs_right_at_the_threshold_meet(dim):
    rng = np.random.default_rng(11)
    n = 1500 if dim < 100 else 200
    a = unit(rng.normal(size=(n, dim)))
    b = rng.normal(size=(n, dim))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    folds = vector_dedup.folds_for(50_000, dim)
    tables = vector_dedup.tables_for(dim, folds, 0.98)
    x, y = vector_dedup.codes(a, tables, folds), vector_dedup.codes(unit(b), tables, folds)
    assert ((x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)).any(axis=1).all()


@pytest.mark.parametrize("cap", [2000, 7])
@pytest.mark.parametrize("noise", [1e-4, 0.02])
def test_hot_group_of_near_copies(spark, cap, noise):
    """A group far longer than the runs that go pair by pair, tight enough for a pivot or not, beside looser ones."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=16) + rng.normal(scale=noise, size=(70, 16)), rng.normal(size=16) + rng.normal(scale=0.08, size=(50, 16))])
    labels = [0] * 110 + [1] * 10
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(frame(spark, x, labels=labels), cap=cap).collect()}
    n, comp = brute(x, labels)
    assert [got[i]["n_links"] for i in range(120)] == n and [got[i]["component_id"] for i in range(120)] == comp


def test_ids_of_several_vectors_and_clashing_columns(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 1), (5, b, 1), (5, a, 1), (3, [0.0, 1.0, 0.01], 1), (9, [1.0, 0.01, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("key", "node", "block", "n", "lo", "hi", "shard", "root", "first"):
        df = df.selectExpr("*", f"'x' as {c}")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df).collect())
    assert got == [(3, 1, 3, True), (5, 1, 3, False), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False)]


def test_cosines_of_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1, 8))
    assert cosine(x * 2.0**600, x * 2.0**-600)[0] == cosine(x, x)[0]
    rows = [(1, [1e200, 1e199], 1), (2, [1e-200, 1e-201], 1), (3, [-1e300, 1e10], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert [r["n_links"] for r in vector_dedup.near_duplicates(df).orderBy("vec_id").collect()] == [1, 1, 0]
    assert [r["vec_id"] for r in ann.nearest(df, df.where("vec_id = 1"), 2).orderBy("rank").collect()] == [2, 3]


def test_a_factor_below_one_keeps_most_neighbours(spark):
    x = sample(1200, 12, 8)
    df = frame(spark, x)
    exact, rough = (
        {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id % 10 = 0"), 5, factor, shard=150).collect()} for factor in (1.0, 0.9)
    )
    assert len(exact) == 600 and len(exact & rough) >= 0.9 * len(exact)


def test_regions_that_lie_too_far_are_left_out():
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(8, 16)) * 5
    x = unit(np.concatenate([m + rng.normal(size=(100, 16)) * 0.3 for m in middles]))
    regions = ann.Regions(x[::4], np.arange(0, 800, 4), 8)
    home = regions.place(x)
    assert len(set(home)) >= 8
    asked = np.arange(0, 800, 7)
    limit = regions.reach(x[asked], asked, 5) + ann.SLACK
    met = {r: asked[q] for r, q in regions.aim(x[asked], limit)}
    assert sum(map(len, met.values())) < 0.5 * len(asked) * len(met)
    for q in asked:
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        assert all(q in met[home[i]] for i in np.argsort(d)[:5])


def test_several_vectors_of_an_id_and_clashing_columns_in_the_search(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [0.0, 1.0], 1), (7, [1.0, 0.1], 1), (8, [0.1, 1.0], 1), (8, [0.1, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("shard", "region", "piece", "slab", "dim", "data", "nth"):
        df = df.selectExpr("*", f"'x' as {c}")
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id = 50"), 2).orderBy("rank").collect()]
    assert got == [(1, 7), (2, 8)]
