"""Token counts by dynamic programming over a trie of distinct pre-tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm import unigram
from ledgerbeam.llm.common import by_text
from ledgerbeam.llm.unigram import NONE, PRE_TOKEN, Pieces, normalize

#: Nodes that a worker's trie holds before it starts anew; this bounds its memory.
NODES = 700_000


class Trie:
    """Prefixes of pre-tokens. A node holds the best score of its prefix and the tokens on that path.

    Both are computed once, when the first pre-token with that prefix comes; a pre-token's own count is kept
    at its end as a terminal.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score: list[float] = [0.0]
        self.count: list[int] = [0]
        self.terminal: dict[str, int] = {}

    def _grow(self, token: str, path: list[int], depth: int) -> int:
        """The node of token[:depth], given those of its shorter prefixes."""
        get, score, count = self.pieces.ends.get, self.score, self.count
        start = depth - 1
        s = get(token[start])
        if s is None or s == NONE:  # no piece of one character
            best, n = score[path[start]] + self.pieces.unknown, count[path[start]] + len(token[start].encode("utf-8"))
        else:
            best, n = NONE, 0
        while s is not None:
            at = path[start]
            if s != NONE and score[at] + s >= best:  # of equal scores the earliest start wins
                best, n = score[at] + s, count[at] + 1
            start -= 1
            if start < 0:
                break
            s = get(token[start:depth])
        score.append(best)
        count.append(n)
        return len(score) - 1

    def insert(self, token: str) -> int:
        """Token count of `token`; new nodes only below the longest prefix that the trie has."""
        path, node, child = [0], 0, self.child
        for depth, c in enumerate(token, 1):
            down = child.get((node, c))
            if down is None:
                down = child[node, c] = self._grow(token, path, depth)
            node = down
            path.append(node)
        self.terminal[token] = self.count[node]
        return self.count[node]

    def total(self, text: str) -> int:
        tokens = PRE_TOKEN.findall(normalize(text))
        try:
            return sum(map(self.terminal.__getitem__, tokens))
        except KeyError:
            pass
        known, n = self.terminal, 0
        for t in tokens:
            found = known.get(t)
            if found is None:
                if len(self.score) + len(t) > NODES:
                    self.clear()
                    known = self.terminal
                found = self.insert(t) if len(t) <= NODES // 4 else len_of_long(self.pieces, t)
            n += found
        return n


def len_of_long(pieces: Pieces, token: str) -> int:
    """Tokens of a pre-token too long for the trie, in windows of the same dynamic program."""
    count, score, size = [0], [0.0], pieces.longest
    get = pieces.score.get
    for depth in range(1, len(token) + 1):
        best, n = NONE, 0
        for start in range(max(0, depth - size), depth):
            s, more = get(token[start:depth]), 1
            if s is None:
                if start < depth - 1:
                    continue
                s, more = pieces.unknown, len(token[start].encode("utf-8"))
            back = len(score) - (depth - start)
            if score[back] + s > best:
                best, n = score[back] + s, count[back] + more
        score.append(best)
        count.append(n)
        if len(score) > 4 * size:
            del score[: -size - 1], count[: -size - 1]
    return count[-1]


def count_tokens(docs: DataFrame, model: str = unigram.DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_tokens): tokens of every whole text under the unigram model in the file `model`.

    Null and empty texts have none; every row keeps its row, ids keep their type; other columns, whatever their
    names, are ignored; an empty table gives an empty result. No shuffle: each worker keeps one trie of the
    distinct pre-tokens it has seen, up to a bound; pre-tokens of over a quarter of it, which share no prefix
    worth keeping, go through the same recurrence in a window as long as the longest piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(unigram.load(model))

    def make():
        pieces = shared.value
        trie = pieces.__dict__.get("trie") or pieces.__dict__.setdefault("trie", Trie(pieces))  # for the worker's life
        return lambda texts: [[trie.total(t) if t else 0 for t in texts]]

    return by_text(docs, ["doc_id"], "n_tokens long", make)


def op8_count_tokens(spark, sf_dir):
    """Query: every document with its tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
