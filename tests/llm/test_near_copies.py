import importlib
import random

from ledgerbeam.llm import near_copies as nc


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def planted(pairs=120):
    """Pairs of texts at 0.80 to 0.95, and some below 0.8, with their similarity."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, alike = [], {}
    while len(alike) < pairs:
        a = [word() for _ in range(rng.randint(60, 400))]
        b = list(a)
        for _ in range(rng.randint(1, max(1, len(a) // 40))):
            b[rng.randrange(len(b))] = word()
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        j = len(x & y) / len(x | y)
        if 0.75 <= j <= 0.95:
            i = 2 * len(alike)
            rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
            alike[i] = j
    return rows, alike


def test_stage_drops_every_planted_copy_from_080(spark):
    rows, alike = planted()
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (None, "q r s t u v"), (900, None), (901, "")], "doc_id long, text string")
    kept = [r["doc_id"] for r in importlib.import_module("corpus_pipeline").drop_near_copies(spark, docs, "").collect()]
    assert sorted(i for i in kept if i is not None and i < 900) == sorted(list(alike) + [i + 1 for i, j in alike.items() if j < 0.8])
    assert sum(0.8 <= j < 0.85 for j in alike.values()) > 10 and sum(j < 0.8 for j in alike.values()) > 10
    assert kept.count(None) == 2 and [i for i in kept if i is not None and i >= 900] == [900]


def test_components_match_brute_force_in_a_hot_band(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    sets = [shingles(t) for _, t in rows]
    root = list(range(90))
    for i in range(90):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for cap in (nc.CAP, 7):
        assert [r["component_id"] for r in nc.near_copies(docs, cap=cap).orderBy("doc_id").collect()] == root
    assert len(set(root)) > 1
    assert nc.near_copies(docs.where("false")).count() == 0
