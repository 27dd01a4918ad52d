import random

import numpy as np
import pytest
import xxhash

from ledgerbeam.llm import simhash


def brute_components(fps, ids, within=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= within:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > len(hashes) / 2)


def test_fingerprint_matches_bit_counts():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "a B c", "a b c d e"]
    texts += [" ".join(rng.choice("ab cd ef Gh".split()) for _ in range(n)) for n in (4, 5, 255, 256, 700)]
    for t in texts:
        assert simhash.majority(simhash.shingle_hashes(t, 4)) == brute_fingerprint(t)


def test_every_pair_within_four_bits_meets_at_a_home():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    other = base.copy()
    for i in range(300):
        for b in rng.choice(64, i % 5, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    ra, ka, ha = simhash.anchors(base)
    rb, kb, hb = simhash.anchors(other)
    for i in range(300):
        a, b = dict(zip(ka[ra == i], ha[ra == i])), dict(zip(kb[rb == i], hb[rb == i]))
        assert any(a[k] or b[k] for k in a.keys() & b.keys())


def test_components_match_brute_force_with_hot_anchors_split(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from ledgerbeam.llm.components import components

    want = brute_components(fps, signed)
    for cap in (20_000, 10):
        got = {r["node"]: r["root"] for r in components(simhash.links(df, 4, cap)).collect()}
        assert [got.get(s, s) for s in signed] == want


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (None, "a b c d e", "y"), (5, "A b  c d e", None), (5, "A b  c d e", None)],
        "doc_id long, text string, fp string",
    )
    rows = sorted(simhash.near_duplicates(docs).select("doc_id", "component_id").collect(), key=str)
    assert [tuple(r) for r in rows] == [(1, 1), (2, 1), (5, 5), (5, 5), (None, 5)]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_signed_hex(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(docs).collect()}
    assert rows[2] == 0 and rows[1] % 2**64 == brute_fingerprint("x y")


@pytest.mark.parametrize("n", [255, 256, 257, 600])
def test_runs_of_an_anchor_on_either_side_of_the_switch(spark, n):
    """Many fingerprints at one anchor: pair by pair up to 256, breadth first beyond; components are the same."""
    rng = np.random.default_rng(n)
    base = np.uint64(0x0123456789ABCDEF)
    flips = rng.integers(22, 64, (n, 5)).astype(np.uint64)  # the first block stays, so that all share its anchor
    fps = np.unique(np.bitwise_xor.reduce(np.uint64(1) << flips, axis=1) ^ base)
    rows = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = np.arange(len(fps))
    while True:
        lower = np.where(near, want[None, :], len(fps)).min(axis=1)
        if (lower == want).all():
            break
        want = lower
    place = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    got = np.arange(len(fps))
    pairs = [(place[r["a"]], place[r["b"]]) for r in simhash.links(rows).collect()]
    assert all(near[a, b] for a, b in pairs) or n > 256
    for _ in range(len(fps)):
        before = got.copy()
        for a, b in pairs:
            got[a] = got[b] = min(got[a], got[b])
        if (got == before).all():
            break
    assert (got == want).all()


def test_exact_ids_long_texts_and_clashing_columns(spark):
    big = 2**53 + 1
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    docs = spark.createDataFrame([(big, long, "x"), (None, None, "y"), (big + 2, long, "z"), (1, "", "q")], "doc_id long, text string, fp string").coalesce(1)
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got[big] == (got[big][0], big) and got[big + 2] == (got[big][0], big) and got[None] == (0, 1) and got[1] == (0, 1)
