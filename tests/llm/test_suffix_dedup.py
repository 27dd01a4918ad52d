import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from ledgerbeam.llm import suffix_dedup as sd


def brute(rows, length):
    """Every string in order of (doc_id, start), against those seen before."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = [True] * length
            seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    texts = []
    passage = " ".join(word() for _ in range(40))
    for i in range(n):
        t = " ".join(word() for _ in range(rng.randint(0, 90)))
        kind = rng.randrange(6)
        if texts and kind == 0:
            t = rng.choice(texts)
        elif texts and kind == 1:
            old = rng.choice(texts)
            k = rng.randint(0, len(old))
            t = old[:k] + word() + old[k:]
        elif kind == 2:
            k = rng.randint(0, len(passage) - 1)
            t = t[:50] + passage[k : k + 130] + t[50:]
        elif kind == 3:
            t = "ab" * rng.randint(0, 200) + t
        texts.append(t)
    return [(i * 3, t) for i, t in enumerate(texts)] + [(1, None), (4, ""), (7, "x" * 350)]


@pytest.mark.parametrize("length,seed", [(100, 1), (40, 2), (100, 3)])
def test_matches_brute_force(spark, length, seed):
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r)[:5] for r in sd.remove_repeats(docs, length).collect())
    assert got == brute(rows, length)
    assert sum(r[2] for r in got) > 500


def test_long_documents_in_pieces(spark, monkeypatch):
    rows = corpus(8, 12)
    long = " ".join(t for _, t in rows if t)
    finder = sd.Finder(100)
    finder.high = []
    whole = finder.batch([5], [0], [long.encode()])
    monkeypatch.setattr(sd, "PIECE", 700)
    finder.high = []
    pieces = finder.batch([5], [0], [long.encode()])
    names = ["pos", "h", "c"]
    assert set(map(tuple, whole[names].tolist())) <= set(map(tuple, pieces[names].tolist()))


def test_blind_trie_sorts():
    rng = random.Random(2)
    for n in (1, 2, 3, 50):
        strings = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(n)]
        assert [strings[i] for i in sd.blind_trie_order(strings)] == sorted(strings)
    rows = np.frombuffer(b"".join(bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(90)), np.uint8).reshape(90, 60)
    rows = np.concatenate([rows, rows[:20]])
    group = np.arange(110) % 3
    order, lcp = sd.deep_shallow(group, rows)
    want = sorted(range(110), key=lambda i: (group[i], rows[i].tobytes()))
    assert [(group[i], rows[i].tobytes()) for i in order] == [(group[i], rows[i].tobytes()) for i in want]
    for k in range(1, 110):
        a, b = rows[order[k - 1]], rows[order[k]]
        same = 60 if (a == b).all() else int((a != b).argmax())
        assert lcp[k] == (same if group[order[k]] == group[order[k - 1]] else -1)


def test_edge_rows(spark):
    s = "q" * 120
    docs = spark.createDataFrame([(2, s, 1), (None, s, 1), (2, s, 1), (2, "r" + s, 1), (9, None, 1)], "doc_id long, text string, pos int")
    got = {}
    for r in sd.remove_repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append(r["n_removed"])
    assert got[None] == [120] and got[9] == [0] and len(got[2]) == 3
    assert sd.remove_repeats(docs.where("false")).count() == 0


@pytest.mark.parametrize("parts", [1, 2])
def test_twin_rows_lose_nothing_in_one_batch_or_two(spark, parts):
    rng = random.Random(5)
    text = " ".join(str(rng.random()) for _ in range(40))
    docs = spark.createDataFrame([(2, text), (2, text)], "doc_id long, text string").coalesce(1)
    docs = docs if parts == 1 else docs.limit(1).union(docs.limit(1))
    got = [(r["n_removed"], r["kept_sha256"]) for r in sd.remove_repeats(docs).collect()]
    assert got == [(0, hashlib.sha256(text.encode()).hexdigest())] * 2


def test_a_document_a_little_over_a_piece_is_not_its_own_repeat(spark):
    rng = random.Random(6)
    for extra in (99, 100, 150, 200, 201):
        text = "".join(rng.choices("abcdefghijklmnop", k=sd.PIECE + extra))
        finder = sd.Finder(100)
        finder.high = []
        found = finder.batch([1], [0], [text.encode()])
        assert len(np.unique(found["pos"])) == len(found)
        if extra == 150:
            row = sd.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
            assert row["n_removed"] == 0 and row["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def letters(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))


def test_lengths_around_a_piece_remove_what_repeats_and_no_more(spark):
    rng = random.Random(31)
    rows, want = [], {}
    for i, extra in enumerate((0, 99, 100, 150, 200, 201)):
        text = letters(rng, sd.PIECE + extra)
        rows.append((2 * i, text))
        want[2 * i] = (0, 0, text)
        copy = text[5000:5150]
        rest = letters(rng, sd.PIECE + extra - 151) + ("#" if text[4999] != "#" else "+")
        rows.append((2 * i + 1, rest + copy))
        want[2 * i + 1] = (150, 1, rest)
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == {
        k: (n, s, hashlib.sha256(t.encode()).hexdigest()) for k, (n, s, t) in want.items()
    }


@pytest.mark.parametrize("partitions", [1, 2, 5])
def test_equal_rows_are_one_document(spark, partitions):
    rng = random.Random(32)
    text, other = letters(rng, 500), letters(rng, 300)
    rows = [(7, text)] * 3 + [(9, other + text[100:250]), (None, other), (None, other)]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("7", 0)] * 3 + [("9", 150)] + [("None", 300)] * 2


@pytest.mark.parametrize("hot,often", [(0, 10**6), (3, 10**6), (2000, 10**6), (2000, 2), (2000, 8), (0, 1)])
def test_hot_anchors_with_ever_new_surroundings(spark, hot, often):
    rng = random.Random(33)
    line, shorter = letters(rng, 90), letters(rng, 40)
    rows = [(i, letters(rng, rng.randint(0, 150)) + rng.choice([line, shorter, line[:60]]) + letters(rng, rng.randint(0, 150))) for i in range(120)]
    rows += [(200 + i, rows[i][1][: 40 + 5 * i] + rows[i + 1][1][20:] + rows[i][1][10:]) for i in range(40)]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, often=often).collect()
    want = {doc: tuple(found) for doc, _, *found in brute(rows, 100)}
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert sum(n for n, _, _ in want.values()) > 2000


def test_multikey_quicksort_sorts_each_group_and_names_ties():
    rng = np.random.default_rng(5)
    for n, kinds in ((0, 2), (1, 2), (400, 2), (400, 50), (3000, 3)):
        words, group = rng.integers(0, kinds, (n, 4)).astype(np.uint64), rng.integers(0, 5, n)
        order, begin, size = sd.multikey_quicksort(group, words)
        key = [(int(group[i]), *words[i].tolist()) for i in order]
        assert key == sorted(key) and sorted(order.tolist()) == list(range(n))
        runs = [(s, m) for s, m in zip(begin.tolist(), size.tolist())]
        assert all(len(set(key[s : s + m])) == 1 for s, m in runs)
        assert sum(m for _, m in runs) == sum(key.count(k) for k in set(key) if key.count(k) > 1)


def test_exact_ids_beside_nulls(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "x" * 300, "q"), (None, None, "r"), (big + 1, "x" * 300, "s")], "doc_id long, text string, bucket string").coalesce(1)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in sd.remove_repeats(docs).collect()}
    assert got == {big: (300, 299), None: (0, 0), big + 1: (300, 300)}


def test_strings_around_a_common_line_spread_over_buckets():
    rng = random.Random(34)
    line, n = letters(rng, 96), 3000
    texts = [letters(rng, 100) + line + letters(rng, 100) for _ in range(n)]
    at = [np.array([150])] * n
    hot, plain = [np.array([sd.HOT_MARK])] * n, [np.array([7])] * n
    made = lambda owners: sd._context_rows(100, 64)(iter([pd.DataFrame({"doc": range(n), "tie": 0, "text": texts, "at": at, "buckets": owners, "hs": plain})]))
    rows = pd.concat(list(made(hot)))
    first = rows[rows["bucket"] < 2 * sd.HOT_MARK]
    held = first["head"].map(len).groupby(first["bucket"]).sum().div(sd.STRING.itemsize).tolist()
    again = sum(len(h) // sd.STRING.itemsize for h in rows["head"]) - sum(held)
    assert sum(held) + again == n * 69 and len(held) == 64 and max(held) < 2 * sum(held) / 64
    assert {k for r in made(plain) for k in r["bucket"]} == {7}
