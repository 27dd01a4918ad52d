"""License rules against a plain search over the same words, and edge rows."""

import random
import re

import duckdb

from ledgerbeam.llm import licenses
from ledgerbeam.llm.licenses import AFTER, BASE, BEFORE, RULES


def plain(text):
    """(n_words, places, found, kept) of one text by loops over all places and rules."""
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places = [(i, label) for i in range(len(found)) for phrase, label in BASE.items() if found[i : i + len(phrase.split())] == phrase.split()]
    hits = []
    for i in range(len(found)):
        window = " " + "".join(w + " " for w in found[max(0, i - BEFORE) : i]) + "<" + " ".join(found[i : i + AFTER]) + " "
        for r in RULES:
            m = r["keyword"] == found[i] and re.search(r["regex"], window)
            if m:
                start = i - (m[0].split("<")[0].count(" ") - 1)
                hits.append((i, start, start + m[0].count(" ") - 1, r["label"], r["weight"], r["rank"]))
                break
    first = lambda a, b: (a[5], a[0]) < (b[5], b[0])
    inside = lambda d, o: o[1] <= d[1] and d[2] <= o[2] and (o[2] - o[1] > d[2] - d[1] or first(o, d))
    outer = [d for d in hits if not any(inside(d, o) for o in hits)]
    kept = [d for d in outer if not any(o[1] < d[2] and d[1] < o[2] and first(o, d) for o in outer)]
    return len(found), places, hits, kept


WORDS = "gnu general public license licence apache software mit cc by nc sa 4 0 version 2 3 v3 or later only licensed under the terms of spdx identifier creative commons attribution all rights reserved copyright c 2019 permission lesser gpl É ß domain in".split()


def cases():
    rng = random.Random(12)
    said = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    said += [None, "", "...", "GNU General\nPublic—License", "gnu general public license", "CC-BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3 or later."]
    said += ["x " * 60_000 + "MIT License" + " y" * 60_000, "MIT license " * 3000, "İ K gnu gpl", "a\0mit\0license"]
    return list(enumerate(said))


def test_scan_equals_a_plain_search(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _words int, `extra.name` int")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        n, places, found, kept = plain(text)
        r = got[i]
        assert (r["_words"], [tuple(p) for p in r["_places"]], [tuple(d) for d in r["_found"]], [tuple(d) for d in r["_kept"]]) == (n, places, found, kept), text
        assert r["extra.name"] == 2
    assert licenses.scan(docs.where("false")).count() == 0


def test_labels_of_known_notices(spark):
    want = {
        "This work is licensed under the GNU General Public License, version 3.": ["gpl-3.0"],
        "GNU LGPL v2.1 or any later version": ["lgpl-2.1-or-later"],
        "SPDX-License-Identifier: Apache-2.0": ["apache-2.0"],
        "Released under CC BY-SA 4.0, and code under the MIT License.": ["cc-by-sa-4.0", "mit"],
        "Redistribution and use in source and binary forms, with or without modification, are permitted": ["bsd"],
        "Die Apache fliegen mit 0 Fehlern, mit Lizenz": [],
        "They dedicated it to the public domain.": ["public-domain"],
    }
    docs = spark.createDataFrame([(t,) for t in want], "text string")
    got = {r["text"]: [d["label"] for d in r["_kept"]] for r in licenses.scan(docs).collect()}
    assert got == want
    assert 200 < len(RULES) and len({r["rank"] for r in RULES}) == len(RULES)


def test_query_on_edge_rows_equals_its_sql(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = [(i, t) for i, t in cases() if t is None or "\0" not in t] + [(None, "MIT License"), (3, "apache license"), (3, "apache license")]
    spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, n_words string, score double").coalesce(1).write.parquet(path)
    con = duckdb.connect(config={"memory_limit": "4GB", "temp_directory": ""})
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    df = licenses.op12_scan_licenses(spark, str(tmp_path))
    assert df.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.execute(f"select {', '.join(df.columns)} from ({licenses.ORACLE_OP12})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
