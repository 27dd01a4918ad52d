"""Secret scans: base patterns, and probabilistic automata inferred from labelled credentials."""

from __future__ import annotations

import heapq
import logging
import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerbeam.llm.common import by_text, free_name

LOG = logging.getLogger(__name__)

#: Kinds in order of listing; `format` spans come from the automata.
KINDS = ("assign", "access", "hex", "format")
_WORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32}[0-9a-f]*")
HINTS = ("passw", "secret", "token", "api")
#: Candidates, all of which the automata score: runs of the characters of credentials, as long as base patterns ask of one.
TOKEN = re.compile("[A-Za-z0-9+/_.=-]{8,}")
#: Least length of a candidate.
SHORTEST = 8
#: Distinct pieces of the credentials of each kind, and of other tokens of each shape, that the automata are fitted on, at most.
SAMPLE = 400
#: Tokens of a shape that are enough for an automaton of their own.
ENOUGH = 20
#: Credentials are learned, and tokens scored, in pieces of this many characters; only the last one ends.
DEPTH = 48
#: Tokens that a worker remembers the gains of.
REMEMBERED = 60_000


def _long_words(text: str, least: int = SHORTEST) -> list[tuple[int, str]]:
    """(start, word) of the words between white space that are long enough to hold a token."""
    at, out = 0, []
    for word in [w for w in text.split() if len(w) >= least]:
        at = text.find(word, at)  # shorter words can't hold it, and longer ones lie behind
        out.append((at, word))
        at += len(word)
    return out


def base_spans(text: str, long_words: list[tuple[int, str]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within each kind.

    Most texts lack the words that the first pattern starts with, and the others match inside long words only.
    """
    found = []
    low = text.lower()
    if any(w in low for w in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for at, word in _long_words(text) if long_words is None else long_words:
        if "AKIA" in word:
            found += [(at + m.start(), at + m.end(), "access") for m in ACCESS.finditer(word) if m.end() - m.start() >= 16]
        if len(word) >= 32:
            found += [(at + m.start(), at + m.end(), "hex") for m in HEX.finditer(word)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def symbol(c: str) -> str:
    """The class of a character in a credential."""
    if "0" <= c <= "9":
        return "9"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "z"
    if "A" <= c <= "F":
        return "A"
    if "G" <= c <= "Z":
        return "Z"
    return c


#: Probability that a state keeps for what it has never seen.
UNSEEN = 0.02
SURE = math.log(1 - UNSEEN)
#: The same for ends: a format that no sample left at some place hardly ends there.
ODD_END = 1e-5
#: Log-odds against a token being a secret before it is looked at: short tokens need more than a good ratio by symbol.
PRIOR = 12.0
#: Ends a sample that is a piece of a token and not its last one; no credential holds it.
GOES_ON = "\n"


def pieces(token: str) -> list[tuple[str, bool]]:
    """(piece, whether the token ends with it): DEPTH characters at a time."""
    body = token.removesuffix(GOES_ON)
    return [(body[i : i + DEPTH], i + DEPTH >= len(body) and body == token) for i in range(0, len(body), DEPTH)]


@dataclass
class Automaton:
    """A deterministic automaton with a probability for each symbol, and for ending, in each state.

    What was never seen in a state gets a small share, as if by chance among `ALPHABET` symbols and the end.
    """

    moves: list[dict[str, int]]
    ways: list[dict[str, float]]
    ends: list[float]
    #: What all samples begin with, letter by letter; the states come after it.
    prefix: str = ""
    #: Where a symbol leads that was never seen in a state: the way of most samples, so that later places still fit.
    onward: list[int] | None = None

    ALPHABET = 12

    def __post_init__(self) -> None:
        smooth = lambda p: math.log(p * (1 - UNSEEN) + UNSEEN / (self.ALPHABET + 1))
        self.steps = [{s: smooth(p) for s, p in out.items()} for out in self.ways]
        self.stops = [math.log(p * (1 - ODD_END) + ODD_END / (self.ALPHABET + 1)) for p in self.ends]
        self.unseen = smooth(0.0)
        self.onward = self.onward or [0] * len(self.moves)

    def score(self, text: str) -> float:
        """Mean log-likelihood of a symbol, the end being one: that of all pieces over their number."""
        total, n, unseen = 0.0, 0, self.unseen
        for piece, last in pieces(text):
            state, fixed = 0, len(self.prefix)
            for c, want in zip(piece, self.prefix):
                total += SURE if c == want else unseen
            for s in map(SYMBOL.__getitem__, piece[fixed:]):
                total += self.steps[state].get(s, unseen)
                state = self.moves[state].get(s, self.onward[state])
            n += len(piece)
            if last:
                total += self.stops[state]
                n += 1
        return total / max(n, 1)


class _Symbols(dict):
    def __missing__(self, c: str) -> str:
        found = self[c] = symbol(c)
        return found


SYMBOL = _Symbols()


def infer(samples: list[str], alpha: float = 0.05) -> Automaton:
    """Merge statistically compatible states of the prefix tree of the pieces of `samples` into an automaton.

    Layer by layer, a state merges with the first larger one of its depth whose counts of symbols and ends, and those
    of the states that follow, agree within Hoeffding's bound; others stay. A state with few samples agrees with any,
    so each layer keeps what the samples can tell apart, with all of its samples behind it. States of different
    depths stay apart: in a loop, a format would forget its length. Symbols are classes of characters, but for a
    beginning that all samples share.
    """
    prefix = os.path.commonprefix(samples) if len(samples) > 2 else ""
    kids: list[dict[str, int]] = [{}]
    flow: list[Counter] = [Counter()]  # pieces that leave a state by each symbol
    ends: list[int] = [0]
    cuts: list[int] = [0]  # pieces that go on elsewhere: neither an end nor a symbol follows here
    for piece, last in (p for text in samples for p in pieces(text)):
        at = 0
        for s in map(SYMBOL.__getitem__, piece.removeprefix(prefix)):
            if s not in kids[at]:
                kids[at][s] = len(kids)
                kids.append({})
                flow.append(Counter())
                ends.append(0)
                cuts.append(0)
            flow[at][s] += 1
            at = kids[at][s]
        (ends if last else cuts)[at] += 1
    seen = [sum(f.values()) + e + c for f, e, c in zip(flow, ends, cuts)]
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def agree(a: int, na: int, b: int, nb: int) -> bool:
        return abs(a / na - b / nb) < width * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            if not agree(ends[a], seen[a], ends[b], seen[b]):
                return False
            for s in kids[a].keys() | kids[b].keys():
                if not agree(flow[a][s], seen[a], flow[b][s], seen[b]):
                    return False
                if min(flow[a][s], flow[b][s]) > 1:
                    todo.append((kids[a][s], kids[b][s]))
        return True

    def fold(p: int, q: int) -> None:
        """Add the tree under q to the one under p."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            flow[a].update(flow[b])
            for counts in (seen, ends, cuts):
                counts[a] += counts[b]
            for s, y in kids[b].items():
                if s in kids[a]:
                    todo.append((kids[a][s], y))
                else:
                    kids[a][s] = y

    layer, settled = [0], []
    while layer:
        settled += layer
        kept, into = [], {}
        for state in sorted((t for r in layer for t in kids[r].values()), key=lambda t: (-seen[t], t)):
            like = next((k for k in kept if compatible(k, state)), None)
            if like is None:
                kept.append(state)
            else:
                fold(like, state)
                into[state] = like
        for r in layer:
            kids[r] = {s: into.get(t, t) for s, t in kids[r].items()}
        layer = kept
    name = {state: i for i, state in enumerate(settled)}
    out_of = [max(1, sum(flow[r].values()) + ends[r]) for r in settled]
    ways = [{s: n / whole for s, n in flow[r].items()} for r, whole in zip(settled, out_of)]
    onward = [name[kids[r][max(flow[r], key=lambda s: (flow[r][s], s))]] if kids[r] else name[r] for r in settled]  # noqa: B023
    return Automaton([{s: name[t] for s, t in kids[r].items()} for r in settled], ways, [ends[r] / n for r, n in zip(settled, out_of)], prefix, onward)


def chain(samples: list[str]) -> Automaton:
    """The automaton whose state is the last symbol: coarse, but few odd strings among the samples can't shape it."""
    counts: dict[str, Counter] = {"": Counter()}
    for piece, last in (p for text in samples for p in pieces(text)):
        state = ""
        for s in map(SYMBOL.__getitem__, piece):
            counts[state][s] += 1
            counts.setdefault(s, Counter())
            state = s
        if last:
            counts[state][""] += 1
    name = {s: i for i, s in enumerate(counts)}
    whole = [max(1, sum(out.values())) for out in counts.values()]
    ways = [{s: v / n for s, v in out.items() if s} for out, n in zip(counts.values(), whole)]
    return Automaton([{s: i for s, i in name.items() if s}] * len(name), ways, [out[""] / n for out, n in zip(counts.values(), whole)])


def shape(token: str) -> str:
    """Which kinds of characters a token has: `a` for lower case, `A` for upper case, `9` for digits, `-` for others."""
    return "".join(sorted({"a" if c in "az" else "A" if c in "AZ" else "9" if c == "9" else "-" for c in set(map(SYMBOL.__getitem__, token))}))


@dataclass
class Model:
    """Automata of credentials by kind, of ordinary tokens by shape, and the least gain of each kind that marks a secret.

    The ordinary automaton of shape "" is that of all shapes; it stands in where a shape has too few tokens.
    """

    formats: list[Automaton]
    ordinary: dict[str, Automaton]
    thresholds: list[float]

    def plain(self, token: str) -> float:
        """How ordinary the automaton of the token's shape finds it, or that of all shapes where there is none."""
        return (self.ordinary.get(shape(token)) or self.ordinary[""]).score(token)

    def gain(self, token: str) -> float | None:
        """The largest log-likelihood ratio by symbol, of a format against ordinary tokens, over what it has to reach.

        That is its kind's threshold, and as much as outweighs PRIOR over the whole token. A token that would be marked
        has to gain as much on the automaton of all shapes. It is marked from 0 on; null where no format was learned.
        """
        if not self.formats:
            return None
        least = PRIOR / (len(token) + 1)
        own = max(a.score(token) - max(t, least) for a, t in zip(self.formats, self.thresholds))
        found = own - self.plain(token)
        return found if found < 0 else min(found, own - self.ordinary[""].score(token))

    def marks(self, token: str) -> bool:
        """Whether the token passes the threshold of a kind."""
        found = self.gain(token)
        return found is not None and found >= 0


class _Gains(dict):
    """Gain by token, for a worker's life; tokens longer than a piece are scored each time."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float | None:
        found = self.model.gain(token)
        if len(token) <= DEPTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = found
        return found


def _tokens(long_words: list[tuple[int, str]], taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Candidate tokens that no base span touches. Words and spans come in order of their starts, so one sweep does."""
    k = reach = 0
    for at, word in long_words:
        for m in TOKEN.finditer(word):
            s, e = at + m.start(), at + m.end()
            while k < len(taken) and taken[k][0] < e:
                reach = max(reach, taken[k][1])
                k += 1
            if reach <= s:
                yield s, e


def separate(known: dict[str, list[str]], others: list[str]) -> Model:
    """Formats of the known credentials, ordinary tokens without those that score as credentials, and thresholds.

    Other tokens are unlabelled, and some may be secrets that no base pattern knows. By chains of symbols, those
    as likely a kind's as ordinary, or likelier, leave the ordinary ones, whose chain is counted anew until none
    leaves. A third of the credentials of a kind, and of the ordinary tokens of each shape, are kept back from the
    inference. A kind's threshold lies half way from the largest gain of the ordinary ones kept back to what nine
    tenths of its own gain; it is at least 0, where either is as likely. A kind that over half of the other tokens are likelier in can't be told from them; it is left out,
    and logged.
    """
    parts = {k: (v[len(v) // 3 :], v[: len(v) // 3]) for k, v in known.items()}
    chains = {k: chain(train) for k, (train, _) in parts.items()}
    rest, passed = others, {k: set() for k in parts}
    while parts:
        ordinary = chain(rest)
        for k in parts:
            passed[k] |= {x for x in others if chains[k].score(x) >= ordinary.score(x)}
        alike = [k for k in parts if 2 * len(passed[k]) > len(others)]
        if alike:
            LOG.warning("credentials of kind %s look like other tokens; their format marks nothing", ", ".join(alike))
            parts = {k: v for k, v in parts.items() if k not in alike}
            rest, passed = others, {k: set() for k in parts}
            continue
        fewer = [x for x in others if not any(x in p for p in passed.values())]
        if len(fewer) == len(rest):
            break
        rest = fewer
    if not parts or len(rest) < 3:
        LOG.warning("formats are off: no kind of credentials differs from the other tokens")
        return Model([], {}, [])
    shapes: dict[str, list[str]] = {}
    for x in rest:
        shapes.setdefault(shape(x), []).append(x)
    back = {k: v[: len(v) // 3] for k, v in shapes.items()}
    train = {k: v[len(v) // 3 :] for k, v in shapes.items()}
    ordinary = {k: infer(v) for k, v in train.items() if len(v) >= ENOUGH} | {"": infer([x for v in train.values() for x in v])}
    model = Model([infer(own) for own, _ in parts.values()], ordinary, [])
    for a, (_, own) in zip(model.formats, parts.values()):
        gains = lambda v: sorted(a.score(x) - model.plain(x) for x in v)  # noqa: B023, E731
        mine = gains(own)
        edge = mine[len(mine) // 10]
        bad = min(edge, max((g for v in back.values() for g in gains(v)), default=edge))
        model.thresholds.append(max(0.0, bad + 0.5 * (edge - bad)))
    return model


def _smallest(hashes: dict[str, int], n: int) -> list[tuple[str, int]]:
    """The `n` pieces with the smallest hashes, as signed numbers, with these."""
    return heapq.nsmallest(n, hashes.items(), key=lambda x: (x[1] - (x[1] >> 63 << 64), x[0]))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn formats from the credentials that the base patterns label, in all of `docs`.

    For each kind, and for each shape of the tokens outside base spans, the `sample` distinct pieces with the
    smallest hashes are fitted on; finding them reads every text, and a task hands over no more than these. `separate` finds the thresholds. A kind with under
    three pieces has no format. Without a kind, or with under three other tokens, the automata mark nothing, which
    is logged; so an empty table, or one of null texts, gives a model without formats.
    """

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[str, str], dict[str, int]] = {}  # hashes of the pieces of each kind and shape, the least of the task
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = text or ""
                words = _long_words(text)
                spans = base_spans(text, words)
                found = [(k, ASSIGN.match(text, s)[2] if k == "assign" else text[s:e]) for s, e, k in spans]
                found += [("other", text[s:e]) for s, e in _tokens(words, spans)]
                for k, v in found:
                    of = least.setdefault((k, "" if k != "other" else shape(v)), {})
                    for p, last in pieces(v):
                        piece = p if last else p + GOES_ON
                        if piece not in of:
                            of[piece] = xxhash.xxh64_intdigest(piece.encode(), 42)
                    if len(of) > 8 * sample:
                        least[k, "" if k != "other" else shape(v)] = dict(_smallest(of, sample))
        made = [(k, form, v, h - (h >> 63 << 64)) for (k, form), of in least.items() for v, h in _smallest(of, sample)]
        columns = list(zip(*made)) if made else [()] * 4
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.int64())], ["kind", "shape", "value", "hash"])

    found = docs.select("text").mapInArrow(labelled, "kind string, shape string, value string, hash long").distinct()
    found = found.withColumn("part", F.pmod("hash", F.lit(64)))
    for by in (("kind", "shape", "part"), ("kind", "shape")):  # the least of each part, then the least of these
        first = W.partitionBy(*by).orderBy("hash", "value")
        found = found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample)
    values: dict[str, list[str]] = {}
    # at most `sample` rows for each of three kinds and fifteen shapes
    for r in found.select("kind", "shape", "nth", "value").orderBy("kind", "shape", "nth").collect():
        values.setdefault(r["kind"], []).append(r["value"])
    others = values.pop("other", [])
    known = {k: values[k] for k in KINDS if len(values.get(k, ())) >= 3}
    if not known or len(others) < 3:
        LOG.warning("formats are off: under three credentials of every kind, or under three other tokens")
        return Model([], {}, [])
    return separate(known, others)


def all_spans(text: str, model: Model, gains: dict | None = None) -> list[tuple[int, int, str, float | None]]:
    """Base spans, and those tokens whose format is likelier a credential's than an ordinary token's, with their gains.

    Base spans are scored too (of an assignment, what is assigned), and stay whatever their gain.
    """
    gains = _Gains(model) if gains is None else gains
    words = _long_words(text)
    spans = base_spans(text, words)
    found = [(s, e, k, gains[ASSIGN.match(text, s)[2] if k == "assign" else text[s:e]]) for s, e, k in spans]
    if model.formats:
        more = [(s, e, gains[text[s:e]]) for s, e in _tokens(words, spans)]
        marked = [(s, e, "format", g) for s, e, g in more if g >= 0]
        found = sorted(found + marked, key=lambda x: (x[0], KINDS.index(x[2]))) if marked else found
    return found


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans) for each row: spans is an array of (start, end, kind, gain), in code points, end exclusive.

    Null and empty texts have no spans; rows stay as many as they are, repeated ones too, and ids keep their type;
    an empty table gives an empty result; other columns, whatever their names, are ignored. Very long texts are
    scanned whole, in time that follows their length.
    """

    def make():
        gains = _Gains(model)
        tell = lambda t: [{"start": s, "end": e, "kind": k, "gain": g} for s, e, k, g in all_spans(t, model, gains)] if t else []
        return lambda texts: [[tell(t) for t in texts]]

    return by_text(docs, ["doc_id"], "spans array<struct<start:int,end:int,kind:string,gain:double>>", make)


def masked(text: str, spans: list, mask: str) -> str:
    """`text` with each stretch that spans cover replaced by one mask."""
    out, at = [], 0
    for s, e, *_ in spans:
        if e > at:
            out += [text[at:s], mask] if s >= at else []
            at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each secret in `text` replaced by `mask`; n_chars, if there, follows.

    Null and empty texts stay, repeated rows too; other columns keep their values, types and names; an empty
    table stays empty. Where spans overlap, one mask stands for all of them.
    """
    names = docs.columns
    new = free_name(docs, "masked")

    def make():
        gains = _Gains(model)
        clean = lambda t: masked(t, spans, mask) if t and (spans := all_spans(t, model, gains)) else t
        return lambda texts: [[clean(t) for t in texts]]

    found = by_text(docs, [c for c in names if c != "text"], f"`{new}` string", make)
    count = lambda c: F.length(F.col(f"`{new}`")).cast(docs.schema[c].dataType).alias(c)
    keep = {"text": F.col(f"`{new}`").alias("text")} | ({"n_chars": count("n_chars")} if "n_chars" in names else {})
    return found.select(*[keep.get(c, F.col(f"`{c}`")) for c in names])


def op2_scan_secrets(spark, sf_dir):
    """Contract query: counts and digests of the secrets of every document, and the gains of all its spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "format")), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        count("format"),
        F.transform("spans", lambda s: F.round(s["gain"], 6)).alias("gains"),
    )
