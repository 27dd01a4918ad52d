"""Exact removal of repeated byte strings with suffix arrays sorted deep-shallow.

A string of `length` bytes that occurs twice holds, in both places and at the same offset, an anchor: the
32-byte gram with the smallest hash. So only anchors are sent around, about one for every 31 bytes:

1. Texts give their anchors with a hash of the context, the bytes that any string around the anchor can reach.
   Of equal contexts all but the first are repeats throughout. Anchors whose contexts differ need a closer look.
2. For these the context bytes are fetched; of an anchor with very many contexts, a hash of each string. In each bucket the suffixes that start at anchors, and the reversed
   prefixes that end there, are sorted and their common prefixes taken; two strings at the same offset from an
   anchor are equal exactly if both sides agree far enough.
3. The repeated ranges of each document are joined and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import cut, tasks

#: Bytes of an anchor's gram.
GRAM = 32
#: Bytes sorted in words before blind tries take over.
SHALLOW = 40
#: Bytes of text hashed at a time.
PIECE = 1 << 20
#: Bytes of text to a bucket of anchors, about.
PER_BUCKET = 48 << 20
#: Contexts of one anchor that are sorted in one group; of an anchor with more, each string goes where its hash says.
HOT = 2000
#: Added to the buckets of hot anchors.
HOT_MARK = 1 << 40
#: Strings of hot anchors that a task holds at a time.
STRINGS = 200_000
#: Documents that very common anchors are looked for in, about, and how often one has to be there. Results don't depend on it.
SAMPLE, OFTEN = 20_000, 8
#: Marks the anchors found so, in the place of their records.
COMMON = np.uint32(1 << 31)

ANCHOR = np.dtype([("h", "<u4"), ("c", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("pos", "<u4")])
NEED = np.dtype([("g", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("pos", "<u4"), ("left", "<u1"), ("right", "<u1")])
STRING = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("start", "<u4")])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every 32-byte gram, by doubling: bytes, pairs, fours and so on."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < GRAM:
        n = len(h) - step
        a = h[:n]
        h = ((a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) ^ (h[step:] + np.uint64(step * 0x1D8E4E27C47D124F % 2**64))
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _windowed(h: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` of every `width` neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        h = pick(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return pick(h[:-rest], h[rest:]) if rest else h


class Finder:
    """Anchors of documents, gathered into buffers of about PIECE bytes."""

    def __init__(self, length: int):
        self.length, self.width = length, length - GRAM + 1
        self.reach = length - GRAM  # bytes before an anchor that its strings can start at

    def anchors(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, hash, context hash) in a buffer of documents that lie between `bounds`."""
        raw = np.frombuffer(data, np.uint8)
        if len(raw) < self.length:
            none = np.empty(0, np.int64)
            return none, none.astype(np.uint64), none.astype(np.uint64)
        h = gram_hashes(raw)
        least = _windowed(h, self.width, np.minimum)
        for b in bounds[1:-1]:  # windows over an edge between documents
            least[max(0, b - self.length + 1) : b] = 0
        pad = np.zeros(self.width - 1, np.uint64)
        pos = np.flatnonzero(_windowed(np.concatenate([pad, least, pad]), self.width, np.maximum) == h)
        return pos, h[pos], self.contexts(data, h, pos, bounds)

    def contexts(self, data: bytes, h: np.ndarray, pos: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Hash of the bytes from `reach` before to `length` after each anchor, cut at the document's ends."""
        doc = np.searchsorted(bounds, pos, "right") - 1
        left = np.minimum(self.reach, pos - bounds[doc])
        right = np.minimum(self.length, bounds[doc + 1] - pos)
        out = np.zeros(len(pos), np.uint64)
        whole = (left == self.reach) & (right == self.length)
        p = pos[whole] - self.reach
        mixed = np.full(len(p), np.uint64(self.length))
        ends = self.reach + self.length - GRAM
        for offset in [*range(0, ends, GRAM), ends]:  # grams that cover the context
            mixed = (mixed ^ h[p + offset]) * np.uint64(0x9FB21C651E98DF25)
            mixed ^= mixed >> np.uint64(35)
        out[whole] = mixed
        digest = xxhash.xxh64_intdigest
        some = np.flatnonzero(~whole)
        out[some] = [
            digest(data[q - a : q + b], int(a) * 256 + int(b))
            for q, a, b in zip(pos[some].tolist(), left[some].tolist(), right[some].tolist())
        ]
        return out

    def batch(self, docs: list[int], ties: list[int], texts: list[bytes]) -> np.ndarray:
        """Anchor records of whole documents."""
        out, parts, own, size = [], [], [], 0

        def flush() -> None:
            nonlocal parts, own, size
            if parts:
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                pos, h, c = self.anchors(b"".join(parts), bounds)
                at = np.searchsorted(bounds, pos, "right") - 1
                out.append(self._records(h, c, np.array(own)[at], pos - bounds[at]))
            parts, own, size = [], [], 0

        for k, text in enumerate(texts):
            if len(text) < self.length:
                continue
            if len(text) > PIECE:
                out.append(self._giant(text, k))
                continue
            if size + len(text) > PIECE:
                flush()
            parts.append(text)
            own.append(k)
            size += len(text)
        flush()
        found = np.concatenate(out) if out else np.empty(0, ANCHOR)
        k = found["doc"]
        found["tie"] = np.array(ties, np.int64)[k] if len(k) else 0
        found["doc"] = np.array(docs, np.int64)[k] if len(k) else 0
        return found

    def _records(self, h, c, own, pos) -> np.ndarray:
        r = np.empty(len(h), ANCHOR)
        r["h"], r["c"], r["doc"], r["pos"] = h & np.uint64(0xFFFFFFFF), c, own, pos
        r["tie"] = h >> np.uint64(32)  # the bucket comes from here; the tie follows in batch()
        self.high.append(r["tie"].copy())
        return r

    def _giant(self, text: bytes, k: int) -> np.ndarray:
        """A long document in overlapping pieces; what lies in the overlap is the same from either side."""
        out = []
        for s in range(0, len(text) - self.length + 1, PIECE):
            a, b = max(0, s - self.reach), min(len(text), s + PIECE + 2 * self.length)
            piece = text[a:b]
            pos, h, c = self.anchors(piece, np.array([0, len(piece)]))
            inner = (pos + a >= s) | (s == 0)
            # the last but one piece may reach the end as well, but what starts in the last is left to that one
            inner &= (pos + a < s + PIECE) | (s + PIECE > len(text) - self.length)
            # near the edges of a piece windows and contexts are cut: take anchors of windows that start in it
            lows = (pos >= self.reach) | (a == 0)
            highs = (pos + self.length <= len(piece)) | (b == len(text))
            ok = inner & lows & highs
            out.append(self._records(h[ok], c[ok], np.full(ok.sum(), k), pos[ok] + a))
        return np.concatenate(out)

    high: list


def _found(length: int, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Anchor records of a batch, and the higher halves of their hashes."""
    finder = Finder(length)
    finder.high = []
    texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in b["text"]]
    found = finder.batch(b["doc"].tolist(), b["tie"].tolist(), texts)
    return found, np.concatenate(finder.high).astype(np.uint64) if len(found) else np.empty(0, np.uint64)


def _common(given: DataFrame, length: int, sample: int, often: int) -> np.ndarray:
    """Hashes of the anchors that are at `often` or more places of about `sample` documents, in order."""
    share = min(1.0, sample / max(1, given.count()))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, high = _found(length, b)
            yield pd.DataFrame({"h": ((high << np.uint64(32)) | found["h"]).view(np.int64)})

    some = given.where(F.pmod(F.xxhash64("doc", "tie", F.lit(9)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = some.select("doc", "tie", "text").mapInPandas(hashes, "h long").groupBy("h").count().where(F.col("count") >= often)
    # at most an eighth of the sample's anchors
    return np.sort(np.array([r["h"] for r in rows.select("h").collect()], np.int64).view(np.uint64))


def _anchor_rows(length: int, buckets: int, common):
    """Per batch: of equal contexts only the first goes on; the others are repeats already.

    The contexts of one anchor meet in one bucket, but those of the very common ones are dealt by what they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, high = _found(length, b)
            if not len(found):
                continue
            everywhere, whole = common.value, (high << np.uint64(32)) | found["h"]
            at = np.searchsorted(everywhere, whole)
            often = everywhere[np.minimum(at, len(everywhere) - 1)] == whole if len(everywhere) else np.zeros(len(found), bool)
            found["pos"][often] |= COMMON
            bucket = (np.where(often, found["c"] ^ high, high) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((found["pos"], found["tie"], found["doc"], found["c"], found["h"], bucket))
            found, bucket = found[order], bucket[order]
            # one place met twice, as when equal rows share a batch, is no repeat
            once = np.r_[True, (found[1:] != found[:-1])]
            found, bucket = found[once], bucket[once]
            same = np.r_[False, (found["c"][1:] == found["c"][:-1]) & (found["h"][1:] == found["h"][:-1]) & (bucket[1:] == bucket[:-1])]
            keys, rows = [], []
            if same.any():
                keys.append(buckets + int(found["doc"][same][0]) % buckets)
                rows.append(found[same].tobytes())
            first, own = found[~same], bucket[~same]
            edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for s, e in zip(edges, np.r_[edges[1:], len(own)]):
                keys.append(int(own[s]))
                rows.append(first[s:e].tobytes())
            yield pd.DataFrame({"bucket": keys, "data": rows})

    return run


def _classes(buckets: int, hot: int):
    """Per bucket: repeats of a whole context, and first contexts of anchors that have several."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        a = np.frombuffer(b"".join(pdf["data"]), ANCHOR)
        place = lambda a: (a["pos"] & ~COMMON).astype(np.int64)
        if bucket >= buckets:
            return pd.DataFrame({"doc": a["doc"], "tie": a["tie"].astype(np.int64), "pos": place(a), "bucket": -1, "h": 0})
        a = a[np.lexsort((a["pos"], a["tie"], a["doc"], a["c"], a["h"]))]
        new_h = np.r_[True, a["h"][1:] != a["h"][:-1]]
        new_class = new_h | np.r_[True, a["c"][1:] != a["c"][:-1]]
        group = np.cumsum(new_h) - 1
        contexts = np.bincount(group, weights=new_class)[group]
        common = a["pos"] >= COMMON  # its other contexts lie in other buckets
        several = (contexts > 1) | common
        # one row met twice is one document
        twin = np.r_[False, (a[1:] == a[:-1])]
        keep = (~new_class & ~twin) | (new_class & several)
        mark = np.where((contexts > hot) | common, HOT_MARK, 0)[keep]
        a, first = a[keep], new_class[keep]
        return pd.DataFrame({
            "doc": a["doc"], "tie": a["tie"].astype(np.int64), "pos": place(a),
            "bucket": np.where(first, bucket + mark, -1), "h": a["h"].astype(np.int64),
        })

    return run


def _later(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of records of strings: the first of each, and the places of all others. One place met twice is no repeat."""
    strings = np.unique(strings)  # by hash, and then by age
    again = np.r_[False, (strings["a"][1:] == strings["a"][:-1]) & (strings["b"][1:] == strings["b"][:-1])]
    return strings[~again], strings[again]


def _context_rows(length: int, buckets: int):
    """Per batch of documents with anchors to look at: their context bytes, packed by bucket.

    However common a hot anchor is, the strings around it are as different as what surrounds it. So each string that
    holds one goes on by itself, as 128 bits of hash and a place, to the bucket that its hash says; of equal ones the
    batch hands on the first, and the others are repeats already. These lie in buckets from 2 * HOT_MARK on.
    """
    reach = length - GRAM

    def flush(strings: list[np.ndarray]) -> Iterator[tuple]:
        first, again = _later(np.concatenate(strings))
        for mark, rows, by in ((HOT_MARK, first, (first["a"] % np.uint64(buckets)).astype(np.int64)), (2 * HOT_MARK, again, again["doc"] % buckets)):
            order = np.argsort(by, kind="stable")
            edges = np.flatnonzero(np.r_[True, by[order][1:] != by[order][:-1]]) if len(rows) else []
            for s, e in zip(edges, np.r_[edges[1:], len(rows)] if len(rows) else []):
                yield mark + int(by[order[s]]), rows[order[s:e]].tobytes(), b"", b""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["bucket", "head", "before", "after"]
        for b in batches:
            by: dict[int, list] = {}
            strings, held = [], 0
            for doc, tie, text, at, owners, hs in zip(b["doc"], b["tie"], b["text"], b["at"], b["buckets"], b["hs"]):
                data = text.encode("utf-8", "surrogatepass")
                starts: set[int] = set()
                for p, k, h in zip(at.tolist(), owners.tolist(), hs.tolist()):
                    if k >= HOT_MARK:
                        starts.update(range(max(0, p - reach), min(p, len(data) - length) + 1))
                        continue
                    before, after = data[max(0, p - reach) : p], data[p : p + length]
                    by.setdefault(k, []).append(((h, doc, tie, p, len(before), len(after)), before[::-1].ljust(reach, b"\0"), after.ljust(length, b"\0")))
                if starts:
                    made = np.empty(len(starts), STRING)
                    made["start"] = sorted(starts)
                    hashes = [xxhash.xxh3_128_digest(data[s : s + length]) for s in made["start"].tolist()]
                    made["a"], made["b"] = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2).T
                    made["doc"], made["tie"] = doc, tie
                    strings.append(made)
                    held += len(made)
                if held >= STRINGS:
                    yield pd.DataFrame(flush(strings), columns=names)
                    strings, held = [], 0
            rows = []
            for k, found in by.items():
                head = np.array([x[0] for x in found], NEED)
                rows.append((k, head.tobytes(), b"".join(x[1] for x in found), b"".join(x[2] for x in found)))
            yield pd.DataFrame(rows + (list(flush(strings)) if strings else []), columns=names)

    return run


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Indices of `strings`, of equal length, in order, by a blind trie.

    A node knows only the first byte position where the strings under it differ, and a child for each byte
    there. To insert, walk down blindly to any leaf, compare once with its string, and branch where they part.
    """
    leaves: dict[int, list[int]] = {}
    size = len(strings[0])
    values = [int.from_bytes(s, "big") for s in strings]
    root: object = 0
    leaves[0] = [0]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while not isinstance(node, int):
            depth, kids = node
            node = kids.get(s[depth])
            if node is None:
                node = next(iter(kids.values()))
                while not isinstance(node, int):
                    node = next(iter(node[1].values()))
        part = (values[i] ^ values[node]).bit_length()
        if not part:
            leaves[node].append(i)
            continue
        leaves[i] = [i]
        split = size - (part + 7) // 8
        above, node = None, root
        while not isinstance(node, int) and node[0] < split:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == split:
            node[1][s[split]] = i
            continue
        down = node
        while not isinstance(down, int):
            down = next(iter(down[1].values()))
        branch = (split, {strings[down][split]: node, s[split]: i})
        if above is None:
            root = branch
        else:
            above[1][s[above[0]]] = branch
    out: list[int] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            out.extend(leaves[node])
        else:
            todo.extend(kid for _, kid in sorted(node[1].items(), reverse=True))
    return out


def multikey_quicksort(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, begin, size): rows of words sorted within each group, and the runs that are equal in all words.

    Each stretch of rows that agree in their first words takes a pivot and parts in three by the next word: less,
    equal and greater; the equal ones go on with the word after. All stretches of a round part at once.
    """
    n, width = words.shape
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if n else np.empty(0, np.int64)
    stop = np.r_[start[1:], n] if n else start
    depth = np.zeros(len(start), np.int64)
    begin, size = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(start):
        long = stop - start > 1
        tied = long & (depth == width)
        begin.append(start[tied])
        size.append((stop - start)[tied])
        start, stop, depth = (x[long & ~tied] for x in (start, stop, depth))
        if not len(start):
            break
        rows = stop - start
        first = np.cumsum(rows) - rows
        own = np.repeat(np.arange(len(start)), rows)
        at = np.arange(len(own)) - first[own] + start[own]
        word = words[order[at], depth[own]]
        pivot = word[first + rows // 2][own]
        side = 3 * own + (word >= pivot) + (word > pivot)
        order[at] = order[at][np.argsort(side, kind="stable")]
        ends = start[:, None] + np.cumsum(np.bincount(side, minlength=3 * len(start)).reshape(-1, 3), axis=1)
        start, stop = np.c_[start, ends[:, :2]].ravel(), ends.ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()
    return order, np.concatenate(begin), np.concatenate(size)


def deep_shallow(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows of bytes sorted within each group, and the common prefix of each with the one before.

    Multikey quicksort, eight bytes at a time, down to a shallow depth; what is still equal there has
    long common prefixes and goes through blind tries. lcp is -1 where a group begins.
    """
    n, width = rows.shape
    shallow = min(SHALLOW, width) // 8 * 8
    words = np.ascontiguousarray(rows[:, :shallow]).view(">u8").astype(np.uint64).reshape(n, -1)
    order, begin, length = multikey_quicksort(group, words)
    for s, m in zip(begin.tolist(), length.tolist()):
        own = order[s : s + m]
        deep = rows[own, shallow:]
        if m == 2:
            if deep[0].tobytes() > deep[1].tobytes():
                order[s : s + 2] = own[::-1]
        elif deep.shape[1]:
            order[s : s + m] = own[blind_trie_order([d.tobytes() for d in deep])]
    sorted_rows = rows[order]
    lcp = np.full(n, -1, np.int64)
    for s in range(1, n, 50_000):
        differs = sorted_rows[s : s + 50_000] != sorted_rows[s - 1 : min(s + 50_000, n) - 1]
        lcp[s : s + 50_000] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    fresh = np.r_[True, group[order][1:] != group[order][:-1]]
    lcp[fresh] = -1
    return order, lcp


def _ranges(length: int):
    """Per bucket: for each first context, the range of its strings that start earlier elsewhere."""
    reach = length - GRAM

    def hot(pdf: pd.DataFrame, all_are: bool) -> pd.DataFrame:
        strings = np.frombuffer(b"".join(pdf["head"]), STRING)
        found = strings if all_are else _later(strings)[1]
        found = found[np.lexsort((found["start"], found["tie"], found["doc"]))]
        start = found["start"].astype(np.int64)
        # what overlaps in one document is one range
        fresh = np.r_[True, (found["doc"][1:] != found["doc"][:-1]) | (found["tie"][1:] != found["tie"][:-1]) | (start[1:] > start[:-1] + length)][: len(found)]
        last = np.r_[np.flatnonzero(fresh)[1:] - 1, len(found) - 1] if len(found) else np.empty(0, np.int64)
        return pd.DataFrame({"doc": found["doc"][fresh], "tie": found["tie"][fresh].astype(np.int64), "start": start[fresh], "stop": start[last] + length})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        if bucket >= HOT_MARK:
            return hot(pdf, bucket >= 2 * HOT_MARK)
        head = np.frombuffer(b"".join(pdf["head"]), NEED)
        after = np.frombuffer(b"".join(pdf["after"]), np.uint8).reshape(-1, length)
        before = np.frombuffer(b"".join(pdf["before"]), np.uint8).reshape(-1, reach) if reach else np.zeros((len(head), 0), np.uint8)
        head, once = np.unique(head, return_index=True)  # equal rows are one document, whose contexts came once for each
        after, before = after[once], before[once]
        n = len(head)
        group = head["g"]
        right_order, right_lcp = deep_shallow(group, after)
        left_order, left_lcp = deep_shallow(group, before) if reach else (right_order, np.where(right_lcp < 0, -1, 0))
        right_at, left_at = np.empty(n, np.int64), np.empty(n, np.int64)
        by_age = np.lexsort((head["pos"], head["tie"], head["doc"]))
        age = np.empty(n, np.int64)
        age[by_age] = np.arange(n)
        low, high = np.full(n, length, np.int64), np.full(n, -1, np.int64)
        for r in range(reach + 1):
            right_at[right_order] = np.cumsum(right_lcp < length - r)
            left_at[left_order] = np.cumsum(left_lcp < r)
            live = np.flatnonzero((head["left"] >= r) & (head["right"] >= length - r))
            key = right_at[live] * (n + 1) + left_at[live]
            order = np.lexsort((age[live], key))
            later = order[np.r_[False, key[order][1:] == key[order][:-1]]] if len(order) else order
            repeats = live[later]
            low[repeats] = np.minimum(low[repeats], r)
            high[repeats] = r
        some = high >= 0
        p = head["pos"].astype(np.int64)
        return pd.DataFrame({
            "doc": head["doc"][some], "tie": head["tie"][some].astype(np.int64),
            "start": p[some] - high[some], "stop": p[some] - low[some] + length,
        })

    return run


def _cut_out(length: int):
    """Per document: join its ranges, take them out, and describe the rest."""
    reach = length - GRAM

    runs = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            lists = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2, 5))
            for text, at, starts, stops in zip(b.column(1).to_pylist(), *lists):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                begin, end = np.empty(0, np.int64), np.empty(0, np.int64)
                if at is not None and len(at):
                    begin = np.maximum(0, at - reach)
                    end = np.minimum(len(data), at + length)
                    whole = end - begin >= length
                    begin, end = begin[whole], end[whole]
                if starts is not None and len(starts):
                    begin, end = np.r_[begin, starts], np.r_[end, stops]
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
                if len(begin):
                    new = np.r_[True, begin[1:] > end[:-1]]
                    begin, end = begin[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]
                kept, p = hashlib.sha256(), 0
                view = memoryview(data)
                for s, e in zip(begin.tolist(), end.tolist()):
                    kept.update(view[p:s])
                    p = e
                kept.update(view[p:])
                spans = [{"start": s, "stop": e} for s, e in zip(begin.tolist(), end.tolist())]
                rows.append((len(data), int((end - begin).sum()), len(begin), kept.hexdigest(), spans))
            made = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = HOT, sample: int = SAMPLE, often: int = OFTEN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row of `docs`.

    Each byte in a string of `length` UTF-8 bytes (33 to 255) that also starts earlier, in a document of smaller
    doc_id or earlier in the same one, is removed; strings never cross documents and are judged on the input.
    spans are the maximal removed ranges, ends exclusive. Null text counts as empty; texts shorter than `length`
    stay. A null doc_id comes after all others. Rows that share a doc_id count as documents in order of a hash
    of their text; rows that share both are one document, and each gets its result. Other columns, whatever their
    names, are ignored; an empty table gives an empty result. Very long texts are hashed a piece at a time and held
    whole by one task. That two whole contexts are equal is told by 96 bits of hashes of anchor and context, and that
    two strings around an anchor with over `hot` contexts are, by 128 bits; other strings are compared by their bytes.
    """
    if not GRAM < length <= 255:
        raise ValueError("length must be from 33 to 255")
    spark = docs.sparkSession
    given = docs.select(
        "doc_id",
        "text",
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"),
        F.pmod(F.xxhash64("text"), F.lit(2**32)).alias("tie"),
    )
    total = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(tasks(spark), -(-total // PER_BUCKET))
    common = spark.sparkContext.broadcast(_common(given, length, sample, often))
    anchors = given.select("doc", "tie", "text").mapInPandas(_anchor_rows(length, buckets, common), "bucket long, data binary")
    found = cut(
        anchors.groupBy("bucket").applyInPandas(
            _classes(buckets, hot), "doc long, tie long, pos long, bucket long, h long"
        )
    )
    # both joins below deal the texts out alike, so Spark shuffles them once
    texts = given.repartition(max(tasks(spark), buckets), "doc", "tie")
    key = ["doc", "tie"]
    needed = (
        found.where("bucket >= 0")
        .groupBy(*key)
        .agg(F.collect_list("pos").alias("at"), F.collect_list("bucket").alias("buckets"), F.collect_list("h").alias("hs"))
    )
    ranges = (
        texts.join(needed, key)
        .select("doc", "tie", "text", "at", "buckets", "hs")
        .mapInPandas(_context_rows(length, buckets), "bucket long, head binary, before binary, after binary")
        .groupBy("bucket")
        .applyInPandas(_ranges(length), "doc long, tie long, start long, stop long")
    )
    parts = ranges.groupBy(*key).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    whole = found.where("bucket < 0").groupBy(*key).agg(F.collect_list("pos").alias("at"))
    ready = texts.join(whole, key, "left").join(parts, key, "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ready.select("doc_id", "text", "at", "starts", "stops").mapInArrow(
        _cut_out(length),
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>",
    )


def op9_suffix_dedup(spark, sf_dir):
    """Contract query: what is left of every document without strings of 100 bytes that start earlier."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, 100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
