"""A unigram piece model read from a SentencePiece file, and Viterbi steps over it.

The file is only read, on the driver; pieces and scores (a few 10,000 entries, the vocabulary's fixed size)
go to executors as one broadcast. A segmentation's score is the sum of its pieces' scores; of equal scores
the path whose last piece starts earliest wins, and so on backwards. Spaces are written as U+2581, and one
goes before the text, as the file's normalizer says. Characters without a piece become UTF-8 byte pieces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A pre-token: a run of spaces and what follows it. No piece has a space after another character.
PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")
NONE = float("-inf")
#: Pre-tokens that a worker remembers, in each of two generations.
REMEMBERED = 120_000


@dataclass
class Pieces:
    """The vocabulary: piece to (id, score), byte ids, the score of an unknown character, longest piece.

    `tree` spells the pieces: a node is [score, next nodes by character], without a score where no piece ends.
    `ends` also holds every ending of a piece, with no score. So a search for pieces stops where none goes on.
    `pairs` are the neighbouring characters within pieces: between any others every segmentation has a cut.
    """

    score: dict[str, float]
    ident: dict[str, int]
    text: list[str]
    byte_of: dict[int, int]
    unknown: float
    longest: int
    tree: dict[str, list] = field(default_factory=dict)
    ends: dict[str, float] = field(default_factory=dict)
    pairs: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        for piece, score in self.score.items():
            node = [NONE, self.tree]
            for c in piece:
                node = node[1].setdefault(c, [NONE, {}])
            node[0] = score
            for k in range(1, len(piece)):
                self.ends.setdefault(piece[k:], NONE)
        self.ends |= self.score
        self.pairs |= {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}


class Remembered(dict):
    """A cache of `make(key)` in two generations: what is asked for again outlives what isn't."""

    def __init__(self, make, size: int = REMEMBERED, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def load(path: str = DEFAULT_MODEL) -> Pieces:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    text = [p.id_to_piece(i) for i in range(n)]
    bad = [text[i] for i in plain if SPACE in text[i].lstrip(SPACE)]
    if bad:
        raise ValueError(f"pieces with an inner space: {bad[:3]}")
    score = {text[i]: float(p.get_score(i)) for i in plain}
    return Pieces(
        score,
        {text[i]: i for i in plain},
        text,
        {i: int(text[i][3:5], 16) for i in range(n) if p.is_byte(i)},
        min(score.values()) - 10.0,
        max(map(len, score)),
    )


def normalize(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def forward(m: Pieces, text: str, entry: list[float], stop: int) -> tuple[list[float], list[int]]:
    """Best score to reach each place of `text`, and the place before it on the best path.

    `entry[i]` is the score of arriving at place i from before the text; its place before is -1. Pieces start
    before `stop` only, and may end after it.
    """
    n = len(text)
    best = entry + [NONE] * (n + 1 - len(entry))
    back = [-1] * (n + 1)
    first, unknown = m.tree.get, m.unknown
    for i in range(min(stop, n)):
        at = best[i]
        if at == NONE:
            continue
        j = i + 1
        node = first(text[i])
        if node is None or node[0] == NONE:  # no piece of one character
            if at + unknown > best[j]:
                best[j], back[j] = at + unknown, i
        while node is not None:
            s, after = node
            if at + s > best[j]:
                best[j], back[j] = at + s, i
            if j == n:
                break
            node = after.get(text[j])
            j += 1
    return best, back


def ids_of(m: Pieces, piece: str) -> list[int]:
    i = m.ident.get(piece)
    if i is not None:
        return [i]
    return [m.id_of_byte[b] for b in piece.encode("utf-8")]


def path(back: list[int], end: int) -> list[int]:
    """Places on the best path to `end`, first to last; it begins where the path enters the text."""
    places = [end]
    while back[places[-1]] >= 0:
        places.append(back[places[-1]])
    return places[::-1]


def encode_pre_token(m: Pieces, token: str) -> list[int]:
    """Ids of one pre-token."""
    _, back = forward(m, token, [0.0], len(token))
    ident, out, end = m.ident, [], len(token)
    while end > 0:
        start = back[end]
        i = ident.get(token[start:end])
        if i is None:
            out.extend(reversed(ids_of(m, token[start:end])))
        else:
            out.append(i)
        end = start
    out.reverse()
    return out


def core_length(m: Pieces, token: str) -> int:
    """Characters of a pre-token before those that stand alone at its end, as signs after a word mostly do."""
    n = len(token)
    while n > 1 and token[n - 2 : n] not in m.pairs:
        n -= 1
    return n


def decode(m: Pieces, ids) -> str:
    """The text of an array or list of ids: the inverse of encoding, but that U+2581 comes back as a space."""
    found = m.__dict__.get("bytes_of")
    if found is None:
        plain = [t.replace(SPACE, " ").encode("utf-8") for t in m.text]
        found = m.bytes_of = [bytes([m.byte_of[i]]) if i in m.byte_of else b for i, b in enumerate(plain)]
    ids = ids.tolist() if hasattr(ids, "tolist") else ids
    return b"".join(map(found.__getitem__, ids)).decode("utf-8", "replace")[1:]
