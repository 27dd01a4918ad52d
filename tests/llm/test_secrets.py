import random
import re

from ledgerbeam.llm import secrets


def test_base_spans_follow_the_rules():
    text = "API_key='abcdefgh1' secret: short token=12345678 AKIAABCDEFGHIJKL AKIA123 " + "0f" * 16 + " paſſword=12345678"
    got = [(text[s:e], k) for s, e, k in secrets.base_spans(text)]
    assert got == [("API_key='abcdefgh1", "assign"), ("token=12345678", "assign"), ("AKIAABCDEFGHIJKL", "access"), ("0f" * 16, "hex")]
    plain = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["token", "=", ": ", '"', "abc", "12345678", " ", "Secret", "é", "x"]) for _ in range(14))
        want = [m.span() for m in plain.finditer(t) if len(m[2]) >= 8]
        assert [(s, e) for s, e, k in secrets.base_spans(t) if k == "assign"] == want
    for _ in range(300):
        t = "".join(rng.choice(["AKIA", "0f" * 9, "Z9", "a" * 30, " ", "\n", "\u3000", "-", "é", "AKIAABCDEFGHIJ12"]) for _ in range(14))
        want = [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert secrets.base_spans(t) == sorted(want)


def test_automata_tell_formats_apart():
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(120)]
    cards = ["".join(rng.choice("0123456789") for _ in range(16)) for _ in range(120)]
    a, b = secrets.infer(hexes[:80]), secrets.infer(cards[:80])
    assert (len(a.moves), len(b.moves)) == (41, 17)  # one state for each place: thousands in the tree
    assert all(a.score(x) > b.score(x) for x in hexes[80:])
    assert all(b.score(x) > a.score(x) for x in cards[80:])


def test_automata_learn_lengths():
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    for n in (32, 40):
        a = secrets.infer([draw(n) for _ in range(200)])
        assert all(a.score(x) > a.score(x[: n // 2]) + 0.5 for x in (draw(n) for _ in range(100)))


def test_no_ordinary_word_of_the_corpus_is_marked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert secrets.scan(docs, secrets.fit(docs)).where("exists(spans, s -> s.kind = 'format')").count() == 0


def test_base_columns_of_the_query_against_plain_search(spark):
    """n_* and base_sha256 of the registered query, held against an independent scan of all documents."""
    import hashlib

    def plain(text):
        spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[1]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
        return sorted(spans + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32])

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    got = secrets.op2_scan_secrets(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        spans = plain(docs[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


def test_scan_and_redact(spark):
    rng = random.Random(6)
    h = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    u = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(30))
    rows = [(i, f'say token = "{h()}" and {rng.randrange(10**15, 10**16)} end') for i in range(90)]
    rows += [(200, None), (201, ""), (202, f"bare {u()} here"), (203, "plain words only"), (203, "plain words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secrets.fit(docs)
    got = {}
    for r in secrets.scan(docs, model).collect():
        got.setdefault(r["doc_id"], []).append([(s["kind"], s["start"], s["end"]) for s in r["spans"]])
    assert got[200] == [[]] and got[201] == [[]] and got[203] == [[], []]
    assert all([k for k, _, _ in got[i][0]] == ["assign", "hex"] for i in range(90))
    assert [k for k, _, _ in got[202][0]] == ["format"]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model).collect()}
    assert clean[202] == "bare [SECRET] here" and clean[200] is None and "[SECRET]" in clean[0] and 'token' not in clean[0]
    assert secrets.scan(docs.where("false"), model).count() == 0
    assert secrets.fit(docs.where("false")).formats == []


def test_unknown_secrets_among_the_other_tokens_stay_marked():
    rng = random.Random(9)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexes = lambda n, k: [draw("0123456789abcdef", n) for _ in range(k)]
    for size in (90, 300):
        for share in (0.05, 0.1, 0.2):
            unknown = hexes(30, int(size * share))
            cards = [draw("0123456789", 16) for _ in range(size - len(unknown))]
            others = unknown + cards
            rng.shuffle(others)
            model = secrets.separate({"hex": hexes(40, 90), "assign": hexes(40, 90)}, others)
            fresh, plain = hexes(30, 200), [draw("0123456789", 16) for _ in range(200)]
            assert sum(map(model.marks, unknown)) >= 0.9 * len(unknown)
            assert sum(map(model.marks, fresh)) >= 180
            assert sum(map(model.marks, plain)) <= 10


def test_a_kind_like_ordinary_tokens_is_left_out(caplog):
    rng = random.Random(10)
    cards = ["".join(rng.choice("0123456789") for _ in range(16)) for _ in range(300)]
    model = secrets.separate({"assign": cards[:100]}, cards[100:])
    assert not any(map(model.marks, cards)) and "assign" in caplog.text


def test_a_fifth_of_unknown_secrets_does_not_switch_the_scan_off(spark):
    rng = random.Random(12)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    rows = [(i, f'token = "{draw("0123456789abcdef", 40)}" and {draw("0123456789", 16)} end') for i in range(120)]
    rows += [(1000 + i, f'bare {draw("0123456789abcdef", 30)} here') for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, secrets.fit(docs)).collect()}
    assert sum(clean[1000 + i] == "bare [SECRET] here" for i in range(30)) >= 27
    assert sum(bool(re.search("[0-9]{16} end", clean[i])) for i in range(120)) >= 117


def test_formats_that_no_base_pattern_knows(spark):
    """Bare credentials among words, names, numbers and paths: precision and recall of the added spans."""
    rng = random.Random(21)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: draw("aeiou", 1).join(draw("bcdfgklmnprst", 1) for _ in range(rng.randint(4, 8)))
    plain = lambda: rng.choice([word(), word(), word().capitalize(), word().upper(), draw(num, 16), f"{word()}/{word()}.html", f"20{draw(num, 2)}-{draw(num, 2)}-{draw(num, 2)}"])
    rows, planted = [], {}
    for i in range(400):
        words = [plain() for _ in range(30)]
        if i % 2:
            words[3] = f"token={draw(low + up + num, rng.randint(20, 40))}"
        elif i % 4:
            planted[i] = words[7] = draw(low + up + num, rng.randint(20, 40))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs, secrets.fit(docs)).collect()}
    text = dict(rows)
    marked = {(i, text[i][s["start"] : s["end"]]) for i, spans in found.items() for s in spans if s["kind"] == "format"}
    hit = marked & set(planted.items())
    assert len(hit) >= 0.9 * len(planted) and len(hit) >= 0.9 * len(marked)
    assert all(s["gain"] is not None for spans in found.values() for s in spans)


def test_ends_and_prefixes_count():
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    a = secrets.infer([draw(16) for _ in range(200)])
    assert a.score(draw(16)) > a.score(draw(13)) and a.score(draw(16)) > a.score(draw(24))
    b = secrets.infer(["AKIA" + draw(12) for _ in range(50)])
    assert b.score("AKIA" + draw(12)) > b.score("BKIB" + draw(12)) + 0.5
    long = "ab9" * 100
    assert [len(p) for p, _ in secrets.pieces(long)] == [48] * 6 + [12] and [e for _, e in secrets.pieces(long)] == [False] * 6 + [True]


def test_ids_columns_and_long_texts_come_back_exactly(spark):
    big = 2**53 + 1
    rows = [(big, "secret=abcdefgh12345", 7, big, "q"), (None, None, None, None, None), (3, "0f" * 300_000 + " x" * 100_000, 1, 2, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans long, masked string")
    model = secrets.fit(docs)
    got = secrets.scan(docs, model).collect()
    assert [r["doc_id"] for r in got] == [big, None, 3] and [len(r["spans"]) for r in got] == [1, 0, 1]
    clean = secrets.redact(docs, model)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    assert [tuple(r) for r in clean.collect()] == [(big, "[SECRET]", 8, big, "q"), (None, None, None, None, None), (3, "[SECRET]" + " x" * 100_000, 200_008, 2, "r")]
    assert secrets.redact(docs.where("false"), model).count() == 0
