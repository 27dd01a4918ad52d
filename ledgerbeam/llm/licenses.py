"""License scans: ordered signature rules behind a keyword prefilter, in DataFrame functions only.

A rule is a regex over the words around one place of its keyword. Rules run only where their keyword stands and a
literal piece of theirs follows; at one place the first in order that matches counts. A detection is the interval of
words that its match covers. One that lies inside another's interval is dropped, and of two that overlap otherwise
the one that comes later in the order.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import table

#: What stands between words once A-Z is lower-cased; words are digits, letters, and all that is not ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The phrases that are found everywhere, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Names of licenses: label | keyword | regex of the words after it | versions. `_` stands for no words.
NAMES = """
gpl | gnu | (?:general public|gpl) licen[cs]e | 1 2 3
gpl | gnu | gpl | 1 2 3
gpl | gpl | _ | 1 2 3
gpl | gpl | licen[cs]e | 1 2 3
gpl-2.0 | gplv2 | _ |
gpl-3.0 | gplv3 | _ |
lgpl | gnu | (?:lesser|library) general public licen[cs]e | 2 2.1 3
lgpl | gnu | lgpl | 2 2.1 3
lgpl | lgpl | _ | 2 2.1 3
lgpl-2.1 | lgplv2 | 1 |
lgpl-3.0 | lgplv3 | _ |
agpl | gnu | affero general public licen[cs]e | 1 3
agpl | agpl | _ | 1 3
agpl-3.0 | agplv3 | _ |
gfdl | gnu | free documentation licen[cs]e | 1.1 1.2 1.3
gfdl | gfdl | _ | 1.1 1.2 1.3
apache | apache | licen[cs]e | 1 1.1 2
apache | apache | software licen[cs]e | 1 1.1 2
apache-2.0 | apache | (?:v2|2 0) |
mit | mit | licen[cs]e |
mit | mit | x11 licen[cs]e |
mit | mit | style licen[cs]e |
mit-0 | mit | no attribution |
x11 | x11 | licen[cs]e |
bsd | bsd | licen[cs]e |
bsd | bsd | style licen[cs]e |
bsd-2-clause | bsd | (?:2|two) clause(?: licen[cs]e)? |
bsd-2-clause | simplified | bsd licen[cs]e |
bsd-2-clause | freebsd | licen[cs]e |
bsd-3-clause | bsd | (?:3|three) clause(?: licen[cs]e)? |
bsd-3-clause | revised | bsd licen[cs]e |
bsd-4-clause | bsd | (?:4|four) clause(?: licen[cs]e)? |
0bsd | 0bsd | _ |
0bsd | zero | clause bsd licen[cs]e |
isc | isc | licen[cs]e |
zlib | zlib | (?:libpng )?licen[cs]e |
libpng | libpng | licen[cs]e |
bsl | boost | software licen[cs]e | 1
mpl | mozilla | public licen[cs]e | 1 1.1 2
mpl | mpl | _ | 1 1.1 2
epl | eclipse | public licen[cs]e | 1 2
epl | epl | _ | 1 2
eupl | european | union public licen[cs]e | 1.1 1.2
eupl | eupl | _ | 1.1 1.2
cddl | common | development and distribution licen[cs]e | 1 1.1
cddl | cddl | _ | 1 1.1
cpl | common | public licen[cs]e | 1
ipl | ibm | public licen[cs]e | 1
artistic | artistic | licen[cs]e | 1 2
psf | python | software foundation licen[cs]e | 2
psf | psf | licen[cs]e | 2
php | php | licen[cs]e | 3 3.01
ruby | ruby | licen[cs]e |
postgresql | postgresql | licen[cs]e |
openssl | openssl | licen[cs]e |
unicode | unicode | licen[cs]e |
ms-pl | microsoft | public licen[cs]e |
ms-rl | microsoft | reciprocal licen[cs]e |
afl | academic | free licen[cs]e | 2.1 3
osl | open | software licen[cs]e | 2.1 3
ofl | sil | open font licen[cs]e | 1 1.1
ofl | ofl | _ | 1 1.1
odbl | open | (?:data commons open )?database licen[cs]e | 1
odbl | odbl | _ | 1
odc-by | odc | by | 1
pddl | pddl | _ | 1
cecill | cecill | _ | 1 2 2.1
vim | vim | licen[cs]e |
ncsa | ncsa | open source licen[cs]e |
w3c | w3c | software (?:notice and )?licen[cs]e |
curl | curl | licen[cs]e |
json | json | licen[cs]e |
upl | universal | permissive licen[cs]e | 1
mulan | mulan | (?:psl|permissive software licen[cs]e) | 1 2
busl | business | source licen[cs]e | 1.1
sspl | server | side public licen[cs]e | 1
elastic | elastic | licen[cs]e | 1 2
openrail | openrail | _ |
openrail | open | rail(?: m)? licen[cs]e |
unlicense | unlicense | _ |
wtfpl | wtfpl | _ | 1 2
cc0 | cc0 | _ | 1
cc0 | creative | commons zero | 1
cc-by | cc | by | 1 2 2.5 3 4
cc-by-sa | cc | by sa | 1 2 2.5 3 4
cc-by-nd | cc | by nd | 1 2 2.5 3 4
cc-by-nc | cc | by nc | 1 2 2.5 3 4
cc-by-nc-sa | cc | by nc sa | 1 2 2.5 3 4
cc-by-nc-nd | cc | by nc nd | 1 2 2.5 3 4
cc-by | creative | commons attribution | 1 2 2.5 3 4
cc-by-sa | creative | commons attribution share ?alike | 1 2 2.5 3 4
cc-by-nd | creative | commons attribution no ?deriv(?:ative)?s(?: works)? | 1 2 2.5 3 4
cc-by-nc | creative | commons attribution non ?commercial | 1 2 2.5 3 4
cc-by-nc-sa | creative | commons attribution non ?commercial share ?alike | 1 2 2.5 3 4
cc-by-nc-nd | creative | commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? | 1 2 2.5 3 4
creative-commons | creative | commons(?: licen[cs]e)? |
"""

#: Sentences of license texts and notices: label | weight in hundredths | regex, with the keyword after `<`.
NOTICES = """
mit | 100 | <permission is hereby granted free of charge to any person obtaining a copy
x11 | 95 | <permission to use copy modify distribute and sell this software
isc | 100 | <permission to use copy modify and or distribute this software for any purpose with or without fee
hpnd | 90 | <permission to use copy modify and distribute this software and its documentation
gfdl | 100 | <permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation
bsd | 100 | <redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 90 | neither the name of .{1,40}may be used to <endorse or promote products
bsl | 95 | <boost software license version 1 0 august 17th 2003
gpl | 100 | <redistribute it and or modify it under the terms of the gnu general public licen[cs]e
lgpl | 100 | <redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
agpl | 100 | <redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
gpl | 90 | free software foundation <gnu general public licen[cs]e
apache-2.0 | 100 | you may not use this file <except in compliance with the license
mpl | 100 | source code form is subject to the terms of the <mozilla public licen[cs]e
zlib | 95 | this software is provided as is without any <express or implied warranty
unlicense | 100 | this is free and <unencumbered software released into the public domain
public-domain | 50 | public <domain
public-domain | 90 | (?:dedicated to|released into|placed in|in) the public <domain
wtfpl | 95 | do what the .{4} you want to <public licen[cs]e
all-rights-reserved | 40 | all rights <reserved
all-rights-reserved | 60 | <copyright(?: c)? (?:19|20)[0-9][0-9] .{0,40}all rights reserved
copyright | 30 | <copyright(?: c)? (?:19|20)[0-9][0-9]
copyright | 20 | <copyrighted material
proprietary | 60 | <proprietary and confidential
proprietary | 70 | unauthorized copying of this file .{0,40}is strictly <prohibited
warranty | 20 | without <warranty of any kind
"""

#: What stands before a license's name in a notice.
UNDER = r"(?:(?:this|the) (?:work|software|file|program|code|project|document) is )?(?:licen[cs]ed|released|distributed|published|provided|covered|(?:made )?available) (?:only )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
SPDX = r"spdx licen[cs]e identifier "
LATER = r"(?: only)?(?: licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?"

#: Words of a window before and after its keyword; no rule looks further.
BEFORE, AFTER = 16, 20


def _rules() -> list[dict]:
    """All rules, first to last: texts and identifiers, then names with more around them before those with less."""
    found = []
    for line in NOTICES.strip().splitlines():
        label, weight, regex = (x.strip() for x in line.split(" | "))
        found.append((0, label, int(weight) / 100, regex))
    for line in NAMES.strip().splitlines():
        label, keyword, rest, versions = (x.strip() for x in line.split("|", 2)[:2] + line.split("|", 2)[2].rsplit("|", 1))
        name = f"<{keyword}" + ("" if rest == "_" else f" {rest}")
        for version in versions.split():
            major, _, minor = version.partition(".")
            number = f"{name}(?: version)? v?{major}" + (f" {minor}" if minor else "(?: 0)?")
            full = f"{label}-{major}.{minor or 0}"
            found += [
                (1, full, 1.0, SPDX + number), (2, f"{full}-or-later", 0.95, UNDER + number + LATER), (3, full, 0.9, UNDER + number),
                (4, f"{full}-or-later", 0.85, number + LATER), (5, full, 0.75, number),
            ]
        found += [(6, label, 0.9, SPDX + name), (7, label, 0.8, UNDER + name), (8, label, 0.5, name)]
    found.sort(key=lambda r: (r[0], -len(r[3])))
    out = []
    for rank, (_, label, weight, regex) in enumerate(found):
        tail = regex.split("<", 1)[1]
        need = re.match(r"[a-z0-9]+(?: [a-z0-9]+(?![?*a-z0-9]))*", tail.replace("licen[cs]e", "\0"))[0]
        out.append({"keyword": re.match("[a-z0-9]+", tail)[0], "need": f"<{need}", "regex": f" {regex} ", "label": label, "weight": weight, "rank": rank})
    return out


RULES = _rules()


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def scan(docs: DataFrame, rules: list[dict] = RULES) -> DataFrame:
    """`docs` with what is found in `text`, in columns _words (count), _places, _found and _kept.

    `_places` are the base phrases as (word, label); `_found` all detections by place, and `_kept` those that nothing
    suppresses, as (place, start, stop, label, weight, rank), words from 0, stop exclusive. Null and empty texts have
    no words and nothing found. Texts are scanned whole, each row by itself: there is no shuffle, repeated rows each
    keep theirs, and other columns stay; one that is called as these four is replaced, and _list, _keys, _at,
    _windows and _outer are dropped. Empty tables stay empty.
    """
    grouped: dict[str, list] = {}
    for r in rules:
        grouped.setdefault(r["keyword"], []).append(r)
    by_keyword = F.from_json(F.lit(json.dumps(grouped)), "map<string, array<struct<need: string, regex: string, label: string, weight: double, rank: int>>>")
    keywords = F.array(*[F.lit(k) for k in sorted(set(grouped) | {p.split()[0] for p in BASE})])
    listed = docs.withColumn("_list", words(F.col("text"))).withColumn("_keys", F.array_intersect("_list", keywords))
    at = F.filter(F.sequence(F.lit(1), F.size("_list")), lambda i: F.array_contains("_keys", F.get("_list", i - 1)))
    placed = listed.withColumn("_at", F.when(F.size("_keys") > 0, at).otherwise(F.array().cast("array<int>")))

    def window(i: Column) -> Column:
        before = F.slice("_list", F.greatest(F.lit(1), i - BEFORE), F.least(F.lit(BEFORE), i - 1))
        return F.concat(F.lit(" "), F.array_join(F.concat(before, F.array(F.concat(F.lit("<"), F.array_join(F.slice("_list", i, F.lit(AFTER)), " ")))), " "), F.lit(" "))

    windows = F.transform("_at", lambda i: F.struct(i.alias("i"), F.get("_list", i - 1).alias("word"), window(i).alias("w")))

    def first(p: Column) -> Column:
        hits = F.transform(
            F.filter(F.try_element_at(by_keyword, p["word"]), lambda r: F.contains(p["w"], r["need"])),
            lambda r: F.struct(r["rank"].alias("rank"), F.call_function("regexp_extract", p["w"], r["regex"], F.lit(0)).alias("hit"), r["label"].alias("label"), r["weight"].alias("weight")),
        )
        return F.array_min(F.filter(hits, lambda h: h["hit"] != ""))

    def detection(p: Column) -> Column:
        h = p["best"]
        start = p["i"] - _spaces(F.substring_index(h["hit"], "<", 1))
        return F.struct(
            (p["i"] - 1).alias("place"), start.alias("start"), (start + _spaces(h["hit"]) - 1).alias("stop"),
            h["label"].alias("label"), h["weight"].alias("weight"), h["rank"].alias("rank"),
        )

    places = F.filter(
        F.transform("_windows", lambda p: F.struct((p["i"] - 1).cast("long").alias("word"), F.coalesce(*[
            F.when(F.contains(p["w"], F.lit(f" <{phrase} ")), label) for phrase, label in BASE.items()
        ]).alias("label"))),
        lambda p: p["label"].isNotNull(),
    )
    best = F.transform("_windows", lambda p: F.struct(p["i"].alias("i"), first(p).alias("best")))
    found = F.transform(F.filter(best, lambda p: p["best"].isNotNull()), detection)
    near = BEFORE + AFTER  # detections that meet have places no further apart, and one place has one detection

    def rest(name: str, drops) -> Column:
        """The detections of `name` that no other one near them drops."""
        return F.filter(name, lambda d, n: ~F.exists(F.slice(name, F.greatest(F.lit(1), n + 1 - near), F.lit(2 * near + 1)), lambda o: drops(d, o)))

    def inside(d: Column, o: Column) -> Column:
        wider = (o["stop"] - o["start"] > d["stop"] - d["start"]) | (o["rank"] < d["rank"]) | ((o["rank"] == d["rank"]) & (o["place"] < d["place"]))
        return (o["start"] <= d["start"]) & (d["stop"] <= o["stop"]) & wider

    def beaten(d: Column, o: Column) -> Column:
        before = (o["rank"] < d["rank"]) | ((o["rank"] == d["rank"]) & (o["place"] < d["place"]))
        return (o["start"] < d["stop"]) & (d["start"] < o["stop"]) & before

    return (
        placed.withColumn("_windows", windows)
        .withColumn("_places", places)
        .withColumn("_found", found)
        .withColumn("_outer", rest("_found", inside))
        .withColumn("_kept", rest("_outer", beaten))
        .withColumn("_words", F.size("_list").cast("long"))
        .drop("_list", "_keys", "_at", "_windows", "_outer")
    )


def op12_scan_licenses(spark, sf_dir):
    """Contract query: base phrases and labels of every document; a document without any scores 0."""
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    at, base = F.transform("_places", lambda p: p["word"]), F.transform("_places", lambda p: p["label"])
    return got.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        F.size("_places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.concat(base, F.transform("_kept", lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("_kept", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
        F.size("_kept").cast("long").alias("n_kept"),
        F.size("_found").cast("long").alias("n_found"),
    )


_QUOTED = ",\n".join(f"('{r['keyword']}', '{r['need']}', '{r['regex']}', '{r['label']}', {r['weight']}::DOUBLE, {r['rank']})" for r in RULES)
_KEYS = ", ".join(f"'{k}'" for k in sorted({r["keyword"] for r in RULES} | {p.split()[0] for p in BASE}))
_PHRASES = ", ".join(f"('{p}', '{label}')" for p, label in BASE.items())

ORACLE_OP12 = rf"""
WITH rules(keyword, need, regex, label, weight, rank) AS (VALUES {_QUOTED}),
phrases(phrase, label) AS (VALUES {_PHRASES}),
d AS (SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{BETWEEN[1:]}') AS l FROM documents),
u AS (SELECT nr, unnest(list_transform(list_filter(range(1, len(l) + 1), lambda i: l[i] IN ({_KEYS})), lambda i: {{'i': i, 'word': l[i],
  'w': ' ' || array_to_string(l[greatest(1, i - {BEFORE}):i - 1] || ['<' || array_to_string(l[i:i + {AFTER} - 1], ' ')], ' ') || ' '}})) AS u FROM d),
w AS (SELECT nr, u.i AS i, u.word AS word, u.w AS w FROM u),
places AS (SELECT nr, i - 1 AS word, label FROM w JOIN phrases ON contains(w, ' <' || phrase || ' ')),
hits AS (SELECT nr, i, label, weight, rank, regexp_extract(w, regex) AS hit FROM w JOIN rules ON keyword = word AND contains(w, need)),
best AS (SELECT *, i - (length(b) - length(replace(b, ' ', ''))) AS start FROM (
  SELECT nr, i - 1 AS place, i, rank, hit, label, weight, split_part(hit, '<', 1) AS b FROM hits WHERE hit <> '' QUALIFY row_number() OVER (PARTITION BY nr, i ORDER BY rank) = 1)),
found AS (SELECT nr, place, start, start + (length(hit) - length(replace(hit, ' ', ''))) - 1 AS stop, label, weight, rank FROM best),
outermost AS (SELECT * FROM found a WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.nr = a.nr AND o.start <= a.start AND a.stop <= o.stop
  AND (o.stop - o.start > a.stop - a.start OR o.rank < a.rank OR (o.rank = a.rank AND o.place < a.place)))),
kept AS (SELECT * FROM outermost a WHERE NOT EXISTS (SELECT 1 FROM outermost o WHERE o.nr = a.nr AND o.start < a.stop AND a.start < o.stop
  AND (o.rank < a.rank OR (o.rank = a.rank AND o.place < a.place)))),
k AS (SELECT nr, max(weight) AS score, count(*) AS n FROM kept GROUP BY 1),
b AS (SELECT nr, count(*) AS n, min(word) AS a, max(word) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1),
a AS (SELECT nr, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT nr, label FROM places UNION ALL SELECT nr, label FROM kept) GROUP BY 1),
f AS (SELECT nr, count(*) AS n FROM found GROUP BY 1)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels,
  coalesce(a.labels, '') AS labels, coalesce(k.score, 0)::DOUBLE AS score, coalesce(k.n, 0)::BIGINT AS n_kept, coalesce(f.n, 0)::BIGINT AS n_found
FROM d LEFT JOIN b ON b.nr = d.nr LEFT JOIN a ON a.nr = d.nr LEFT JOIN k ON k.nr = d.nr LEFT JOIN f ON f.nr = d.nr
"""
