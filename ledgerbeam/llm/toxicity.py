"""Toxicity: a learned lexicon trie met with Levenshtein automata, and scores of the hits in their context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import by_text, cut, free_name, release, tasks

#: Words are letters, with single digits or signs that may stand for one between them.
WORD = re.compile(r"[^\W\d_]+(?:[\d@$*!|+][^\W\d_]+)*")
LETTERS = re.compile(r"[^\W\d_]+")
#: What opens a quotation, and what closes it; a paragraph's end closes all.
CLOSES = {'"': '"', "“": "”", "«": "»", "„": "“"}
MARK = re.compile(r'["“”«»„]|\n\s*\n')
#: Labelled documents that lexicon and weights are fitted on, at most, of either label.
FIT_TOXIC, FIT_CLEAN = 4000, 8000
#: An entry of the lexicon must be this many times as common in toxic documents, and be in this many of them.
RATIO, SUPPORT = 40.0, 5
#: Letters of an entry that may hold one misspelling.
FUZZY = 5
#: Words on either side that a hit's context spans.
WINDOW = 12
#: Words and automaton states that a worker remembers.
REMEMBERED, STATES = 80_000, 20_000


def trained_on(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


class Automaton:
    """Levenshtein automata of all entries at once: subsets of (trie node, edits), made as words need them.

    A state holds the trie nodes that some spelling within the allowed edits leads to. Entries that end in `*`
    match words by their beginning, others whole words. Short entries allow no edit, others one.
    """

    def __init__(self, entries: dict[str, float]):
        self.kids: list[dict[str, int]] = [{}, {}]  # root 0: any entry, exactly; root 1: long ones, misspelled
        self.whole: list[float] = [0.0, 0.0]
        self.begun: list[float] = [0.0, 0.0]
        for entry, weight in entries.items():
            word = entry.rstrip("*")
            for root in (0, 1) if len(word) >= FUZZY else (0,):
                at = root
                for c in word:
                    if c not in self.kids[at]:
                        self.kids[at][c] = len(self.kids)
                        self.kids.append({})
                        self.whole.append(0.0)
                        self.begun.append(0.0)
                    at = self.kids[at][c]
                side = self.begun if entry.endswith("*") else self.whole
                side[at] = max(side[at], weight)
        self.clear()

    def clear(self) -> None:
        self.sets: list[frozenset] = []
        self.names: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 1), *self._skip(1, 0)})

    def _skip(self, node: int, edits: int) -> Iterator[tuple[int, int]]:
        """A node, and those reached by leaving out a letter of the entry."""
        yield node, edits
        if edits < 1:
            for kid in self.kids[node].values():
                yield kid, edits + 1

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        key = frozenset((n, e) for n, e in pairs if e == 0 or (n, 0) not in pairs)
        found = self.names.get(key)
        if found is None:
            found = self.names[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return found

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            kids = self.kids[node]
            if c in kids:
                out.update(self._skip(kids[c], edits))
            if edits < 1:
                out.add((node, edits + 1))
                out.update((kid, edits + 1) for kid in kids.values())
        to = self.moves[state][c] = self._state(out)
        return to

    def match(self, word: str) -> tuple[float, float]:
        """(weight if spelled exactly, weight if misspelled); zeros for ordinary words."""
        if len(self.sets) >= STATES:
            self.clear()
        state, exact, near = self.start, 0.0, 0.0
        node = 0
        for c in word:
            if node is not None:
                node = self.kids[node].get(c)
                if node is not None:
                    exact = max(exact, self.begun[node])
            state = self.moves[state].get(c) if c in self.moves[state] else self._step(state, c)
            reached = self.sets[state]
            if not reached:
                break
            near = max(near, max(self.begun[n] for n, _ in reached))
        else:
            near = max([near, *(self.whole[n] for n, _ in self.sets[state])])
            if node is not None:
                exact = max(exact, self.whole[node])
        return exact, 0.0 if exact else near


class _Hits(dict):
    """Word to its match, None for ordinary words."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[float, float] | None:
        found = self.automaton.match(word)
        if not (found[0] or found[1]) and len(parts := LETTERS.findall(word)) > 1:
            found = max(map(self.automaton.match, parts), key=lambda x: (x[0] + x[1], x))
        found = found if found[0] or found[1] else None
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 40:
            self[word] = found
        return found


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of what stands in quotation marks, of any length and over line ends, in one pass.

    Inside one kind of marks the others don't count. A paragraph break ends a quotation that nothing has closed, which
    is then none, so that an odd mark does not turn the rest of the text inside out.
    """
    spans, opened, at = [], None, 0
    for m in MARK.finditer(text):
        mark = m[0]
        if mark[0] == "\n":
            opened = None
        elif opened is None:
            opened, at = CLOSES.get(mark), m.start()
        elif mark == opened:
            spans.append((at, m.end()))
            opened = None
    return spans


def describe(text: str | None, hits: _Hits) -> list[float]:
    """Features of a whole text from its hits and their contexts.

    Hits inside quotation marks count apart. A hit's context score is its weight times one more than the
    number of other hits within WINDOW words: abuse comes in clusters, a mention alone.
    """
    lower = text.lower() if text else ""
    words = WORD.findall(lower)
    marks = list(map(hits.__getitem__, words))
    at = [i for i, v in enumerate(marks) if v is not None]
    if not at:
        return [0.0] * 7
    spans = quotations(lower)
    inside: set[int] = set()
    if spans:
        k = 0
        for i, m in enumerate(WORD.finditer(lower)):
            while k < len(spans) and spans[k][1] <= m.start():
                k += 1
            if k < len(spans) and spans[k][0] <= m.start():
                inside.add(i)
    plain = quoted = near = clustered = top = top_near = 0.0
    low = high = 0  # at[low:high] are the hits within WINDOW words
    for i in at:
        exact, close = marks[i]
        if i in inside:
            quoted += exact + close
            continue
        while at[low] < i - WINDOW:
            low += 1
        while high < len(at) and at[high] <= i + WINDOW:
            high += 1
        clustered += (exact + close) * (high - low - 1)
        plain += exact
        near += close
        top, top_near = max(top, exact), max(top_near, close)
    rate = 1000.0 * len(at) / len(words)
    return [math.log1p(plain), math.log1p(near), math.log1p(quoted), math.log1p(clustered), top, top_near, math.log1p(rate)]


@dataclass
class Model:
    entries: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(8))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = self.weights[0] + rows @ self.weights[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, bias first, by Newton's method with a ridge on all but the bias."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(h, design.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _select(found: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries from (prefix or word, toxic documents, clean documents), the most telling first.

    A prefix over an entry taken before needs documents of its own, and what an entry covers is not taken again.
    """

    def ratio(a: int, b: int) -> float:
        return ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1))

    ranked = sorted(found, key=lambda x: (-x[1] * math.log(ratio(x[1], x[2])), -len(x[0]), x[0]))
    taken: dict[str, float] = {}
    under: dict[str, tuple[int, int]] = {}  # most documents of an entry taken that begins so
    for entry, a, b in ranked:
        stem = entry.rstrip("*")
        if any(stem[:k] + "*" in taken for k in range(1, len(stem) + 1)):
            continue
        below = under.get(stem, (0, 0)) if entry.endswith("*") else (0, 0)
        if a - below[0] >= SUPPORT and ratio(a - below[0], b - below[1]) >= RATIO:
            taken[entry] = math.log(ratio(a, b))
            for k in range(1, len(stem) + 1):
                x = under.get(stem[:k], (0, 0))
                under[stem[:k]] = max(x[0], a), max(x[1], b)
    return taken


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = FIT_TOXIC, clean_rows: int = FIT_CLEAN) -> Model:
    """Learn lexicon and weights from labelled documents, `toxic_rows` and `clean_rows` of them at most.

    These are the ones whose ids have the smallest hashes among those with a label to learn from; of rows that
    share such an id one counts, the one whose text has the smallest hash. Candidates for the lexicon are words and
    their beginnings of four letters or more in these documents, each different text counted once; all that pass RATIO
    and SUPPORT are considered.
    Without toxic or without clean documents, so for empty tables too, the model scores everything 0.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & trained_on(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    near = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = near(known.where("toxic = 1"), toxic_rows).union(near(known.where("toxic = 0"), clean_rows))
    # at most toxic_rows + clean_rows pairs of numbers
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = F.min_by(F.struct("text", F.col("toxic").cast("int").alias("toxic")), F.struct(F.xxhash64("text"), "text")).alias("one")
    spread = met.groupBy("doc_id").agg(one).select("one.*").repartition(tasks(docs.sparkSession))
    rows = cut(spread)
    # copies of one text say no more about its words than one of them
    texts = cut(rows.dropDuplicates(["text", "toxic"]))
    counts = dict(texts.groupBy("toxic").count().collect())
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    nothing = Model({}, np.array([-30.0] + [0.0] * 7))
    if not toxic or not clean:
        return nothing

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = (Counter(), Counter())
            for text, label in zip(b["text"], b["toxic"]):
                words = {w for w in WORD.findall((text or "").lower()) if len(w) >= 4}
                seen[label].update({w[:k] + "*" for w in words for k in range(4, min(len(w), 10) + 1)} | words)
            keys = [k for k in seen[0].keys() | seen[1].keys()]
            yield pd.DataFrame({"entry": keys, "a": [seen[1][k] for k in keys], "b": [seen[0][k] for k in keys]})

    sums = (
        texts.mapInPandas(prefixes, "entry string, a long, b long")
        .groupBy("entry")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where((F.col("a") >= SUPPORT) & ((F.col("a") + 0.5) * (clean + 1) >= RATIO * (F.col("b") + 0.5) * (toxic + 1)))
    )
    # words that five of at most `toxic_rows` documents share: bounded by the sample
    model = Model(_select([tuple(r) for r in sums.collect()], toxic, clean))
    if not model.entries:
        return nothing

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = _Hits(Automaton(model.entries))
        for b in batches:
            yield pd.DataFrame({"x": [describe(t, hits) for t in b["text"]], "toxic": b["toxic"]})

    found = rows.mapInPandas(features, "x array<double>, toxic int").collect()
    release(rows, texts)
    model.weights = _logistic(np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found], float))
    return model


def _scored(model: Model):
    hits = _Hits(Automaton(model.entries))
    return lambda texts: [model.scores(np.array([describe(t, hits) for t in texts], float).reshape(-1, 7))]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row: from 0 to 1, higher for likelier toxic.

    Null counts as empty text, which scores what no hits score. Repeated rows each keep their row, ids their type;
    an empty table gives an empty result; other columns, whatever their names, are ignored. Texts are read whole, in
    time that follows their length.
    """
    return by_text(docs, ["doc_id"], "score double", lambda: _scored(model))


def keep_clean(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows, with all their columns as they are, whose text scores under `below`; null texts as `score` has it."""
    name = free_name(docs, "score")
    return by_text(docs, docs.columns, f"`{name}` double", lambda: _scored(model)).where(F.col(f"`{name}`") < below).drop(name)


def op1_score_toxicity(spark, sf_dir):
    """Contract query: the score of every document, by a model learned from four fifths of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    found = score(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(~trained_on(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
