import math
import random

import numpy as np
import pytest

from ledgerbeam.llm import toxicity as tox

ENTRIES = {"idiot": 5.0, "scum": 4.0, "lowei*": 3.0}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(word):
    exact = max([w for e, w in ENTRIES.items() if word == e or e.endswith("*") and word.startswith(e[:-1])], default=0.0)
    near = 0.0
    for e, w in ENTRIES.items():
        stem = e.rstrip("*")
        if len(stem) >= tox.FUZZY:
            ends = [word[:k] for k in range(len(word) + 1)] if e.endswith("*") else [word]
            if any(distance(x, stem) <= 1 for x in ends):
                near = max(near, w)
    return exact, 0.0 if exact else near


def test_automaton_equals_edit_distance():
    automaton = tox.Automaton(ENTRIES)
    rng = random.Random(1)
    words = ["idiot", "idiots", "idi0t", "idit", "iidiot", "diot", "scum", "scun", "loweiig", "lowe", "lwei", "loweeix", "xlowei", "", "i"]
    words += ["".join(rng.choice("idotlwesc") for _ in range(rng.randint(1, 8))) for _ in range(2000)]
    for w in words:
        assert automaton.match(w) == brute(w), w


def test_quotation_and_clusters():
    hits = tox._Hits(tox.Automaton(ENTRIES))
    plain, quoted = tox.describe("you idiot go", hits), tox.describe('he wrote "you idiot go"', hits)
    assert plain[0] > 0 and quoted[0] == 0 and quoted[2] > 0
    near, far = tox.describe("idiot scum" + " x" * 40, hits), tox.describe("idiot" + " x" * 40 + " scum", hits)
    assert near[3] > far[3] == 0
    assert tox.describe(None, hits) == tox.describe("fine words", hits) == [0.0] * 7


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    fill = lambda: "".join(rng.choice("abemnoprst") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(400):
        words = [fill() for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["vloxum", "grizzat" + fill(), "vloxun"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(900, None, "x"), (901, "", "x"), (5, rows[5][1], "y")], "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")


def test_learns_and_scores(spark, corpus):
    docs, labels = corpus
    model = tox.fit(docs, labels)
    assert any(e.startswith("vloxu") for e in model.entries) and any(e.startswith("grizz") for e in model.entries)
    got = {}
    for r in tox.score(docs, model).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert len(got[5]) == 2 and got[900] == got[901]
    assert all(0 <= s <= 1 for v in got.values() for s in v)
    wrong = sum((got[i][0] >= 0.5) != (i % 5 == 0) for i in range(400))
    assert wrong <= 4
    kept = tox.keep_clean(docs, model)
    assert kept.columns == docs.columns and abs(kept.count() - 323) <= 4


def test_nothing_to_learn_from(spark, corpus):
    docs, labels = corpus
    for some in (labels.where("toxic = 0"), labels.where("false")):
        model = tox.fit(docs, some)
        assert tox.score(docs, model).where("score >= 0.5").count() == 0
    assert tox.score(docs.where("false"), model).count() == 0


def test_many_hits_count_their_neighbours():
    hits = tox._Hits(tox.Automaton(ENTRIES))
    assert tox.describe(("idiot" + " x" * 99 + " ") * 250, hits)[3] == 0
    rng = random.Random(7)
    words = [rng.choice(["idiot", "x", "x", "x"]) for _ in range(1500)]
    at = [i for i, w in enumerate(words) if w == "idiot"]
    want = sum(5.0 * (sum(abs(i - j) <= tox.WINDOW for j in at) - 1) for i in at)
    assert len(at) > 250 and tox.describe(" ".join(words), hits)[3] == pytest.approx(math.log1p(want))


def test_context_counts_follow_brute_force_at_any_number_of_hits():
    hits = tox._Hits(tox.Automaton({"idiot": 2.0}))
    for n, gap in ((199, 40), (200, 40), (250, 100), (300, 5), (250, 13)):
        text = " ".join(" ".join(["word"] * (gap - 1) + ["idiot"]) for _ in range(n))
        at = [i for i, w in enumerate(text.split()) if w == "idiot"]
        near = sum(2.0 * sum(abs(a - b) <= tox.WINDOW for b in at if b != a) for a in at)
        assert abs(tox.describe(text, hits)[3] - np.log1p(near)) < 1e-9


def test_long_quotations_and_odd_marks():
    hits = tox._Hits(tox.Automaton({"idiot": 2.0}))
    quoted = lambda text: tox.describe(text, hits)[2] > 0
    filler = "so it went on and on " * 60
    assert quoted(f'he said "{filler} idiot {filler}" and left') and quoted(f"« {filler}\n{filler} idiot »")
    assert not quoted(f'an odd mark " here\n\n{filler} idiot {filler} "') and quoted(f'an odd mark " here\n\nthen "you idiot" again')
    assert not quoted("idiot") and tox.quotations('"' * 5) == [(0, 2), (2, 4)]


def test_misspellings_with_digits_and_signs_inside():
    hits = tox._Hits(tox.Automaton({"idiot": 2.0, "trash*": 1.0}))
    for text in ("you idi0t", "an !d!ot", "m idi*t", "such tr@sh"):
        assert (sum(tox.describe(text, hits)[:2]) > 0) == (text != "an !d!ot")
    assert tox.describe("idiot@mail.com", hits)[0] > 0


def test_exact_ids_and_clashing_columns(spark):
    big = 2**53 + 1
    rows = [(big, "fine words", big), (None, None, None), (4, "you idiot " * 30_000, 1), (4, "you idiot " * 30_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    model = tox.Model({"idiot": 3.0}, np.array([-4.0, 2, 0, 0, 1, 1, 0, 0]))
    assert [r["doc_id"] for r in tox.score(docs, model).collect()] == [big, None, 4, 4]
    kept = tox.keep_clean(docs, model)
    assert kept.dtypes == docs.dtypes and [tuple(r) for r in kept.collect()] == [rows[0], rows[1]]


def test_repeated_labelled_ids_count_once(spark):
    docs = spark.createDataFrame([(i, f"you moron {i}" if i % 2 else f"a quiet day {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    a = tox.fit(docs, labels)
    b = tox.fit(docs.union(docs.where("doc_id = 7")).union(docs.where("doc_id = 7")), labels.union(labels))
    assert a.entries == b.entries and np.allclose(a.weights, b.weights)
