import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerbeam.llm import sentencepiece_scan as scan
from ledgerbeam.llm import token_counts, unigram

PIECES = unigram.load()


def brute(text):
    """Plain Viterbi over the whole text, ties to the earliest start of the last piece."""
    t = unigram.normalize(text)
    best, back = [0.0] + [unigram.NONE] * len(t), [0] * (len(t) + 1)
    for end in range(1, len(t) + 1):
        for start in range(max(0, end - PIECES.longest), end):
            s = PIECES.score.get(t[start:end])
            if s is None and start == end - 1:
                s = PIECES.unknown
            if s is not None and best[start] + s > best[end]:
                best[end], back[end] = best[start] + s, start
    ids, end = [], len(t)
    while end:
        ids = unigram.ids_of(PIECES, t[back[end] : end]) + ids
        end = back[end]
    return ids


def texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["the ", "of", "and", " ", "  ", "\n", "é", "ñ", "日本", "🎉", "loser", "schaft", "tion", "a", "b", "x.", "1234", "▁"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_whole_encoding_matches_brute_force():
    for t in texts(120):
        got = [i for p in unigram.PRE_TOKEN.findall(unigram.normalize(t)) for i in unigram.encode_pre_token(PIECES, p)]
        assert got == brute(t)
        assert unigram.decode(PIECES, got) == t.replace("▁", " ")


def test_matches_the_library_on_a_unigram_copy_of_the_file():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(open(unigram.DEFAULT_MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = random.Random(9)
    words = "The esndble haedat Engeberö geverü schaft, que la réeux 1984 ciónado. x".split()
    for _ in range(60):
        t = " ".join(rng.choice(words) for _ in range(6))
        assert library.encode(t) == brute(t)


@pytest.mark.parametrize("chunk", [40, 64])
def test_chunked_scan_matches_whole(spark, chunk):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(texts(12, 5))]
    rows += [(50, "".join(rng.choice("thebrnd") for _ in range(700))), (51, " ".join(texts(20, 8))), (52, " " * 300)]
    rows += [(53, None), (54, ""), (51, rows[-1][1]), (None, "ab" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["ids"]) for r in scan.encode(docs, chunk=chunk).collect()), key=str)
    want = sorted(((i, brute(t or "")) for i, t in rows), key=str)
    assert got == want
    back = {r["doc_id"]: r["text"] for r in scan.decode(scan.encode(docs, chunk=chunk)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows if i != 51)
    assert scan.encode(docs.where("false")).count() == 0


def test_max_plus_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(-9, 9, (5, 5)).astype(float) for _ in range(3))
    assert (scan.max_plus(scan.max_plus(a, b), c) == scan.max_plus(a, scan.max_plus(b, c))).all()


def test_trie_counts_match_encoding(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(80, 11))] + [(900, None), (901, ""), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs).collect()), key=str)
    assert got == sorted(((i, len(brute(t or ""))) for i, t in rows), key=str)
    trie = token_counts.Trie(PIECES)
    monkeypatch.setattr(token_counts, "NODES", 60)
    for _, t in rows:
        assert trie.total(t or "") == len(brute(t or ""))
    assert token_counts.count_tokens(docs.where("false")).count() == 0


def test_runs_of_chunks_give_the_same_as_one_scan(spark):
    """Texts of several runs, with and without places that no piece spans, and at either side of two chunks."""
    rng = random.Random(17)
    chunk = 20
    rows = [(1, "".join(rng.choice("thebrndsao") for _ in range(chunk * scan.RUN * 2 + 7))), (2, " ".join(texts(250, 19))[: chunk * scan.RUN * 3])]
    rows += [(10 + k, "".join(rng.choice("the ") for _ in range(2 * chunk + k))) for k in (-1, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in scan.encode(docs, chunk=chunk).collect()} == {i: brute(t) for i, t in rows}


def test_products_and_maps_combine_in_any_order():
    rng = np.random.default_rng(4)
    ms = [rng.integers(-9, 9, (6, 6)).astype(float) for _ in range(9)]
    left = ms[0]
    for m in ms[1:]:
        left = scan.max_plus(left, m)
    halves = [scan.max_plus(scan.max_plus(ms[i], ms[i + 1]), ms[i + 2]) for i in (0, 3, 6)]
    assert (scan.max_plus(halves[0], scan.max_plus(halves[1], halves[2])) == left).all()
    maps = [rng.integers(0, 6, 6) for _ in range(9)]
    for end in range(6):
        state = end
        for come in reversed(maps):
            state = come[state]
        assert scan.chain_of_maps(maps)[end] == state
        assert scan.chain_of_maps([scan.chain_of_maps(maps[:4]), scan.chain_of_maps(maps[4:])])[end] == state


def test_exact_ids_and_clashing_columns(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "a b", "x"), (None, None, "y"), (3, "word " * 60_000, "z")], "doc_id long, text string, ids string").coalesce(1)
    want = [big, None, 3]
    assert [r["doc_id"] for r in token_counts.count_tokens(docs).collect()] == want
    back = scan.encode(docs, decoded=True).collect()
    assert sorted(map(str, (r["doc_id"] for r in back))) == sorted(map(str, want))
    assert {r["doc_id"]: r["text"] for r in back} == {big: "a b", None: "", 3: "word " * 60_000}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()} == {r["doc_id"]: len(r["ids"]) for r in back}


def test_digests_are_those_of_the_decoded_texts(spark):
    """Short texts, a text in chunks, null and empty ones: no text has to come back for its digest."""
    rows = [(i, t) for i, t in enumerate([*texts(20, seed=4), "the loser of " * 40, "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda df, *cols: sorted(map(str, df.select("doc_id", "ids", *cols).collect()))
    got = scan.encode(docs, chunk=64, digest=True)
    assert got.columns == ["doc_id", "ids", "decoded_sha256"]
    assert kept(got, "decoded_sha256") == kept(scan.encode(docs, chunk=64, decoded=True), F.sha2("text", 256).alias("decoded_sha256"))
