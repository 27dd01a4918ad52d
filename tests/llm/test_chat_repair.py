"""Repairs against all ways to edit short conversations, block tables on either side of their lengths, edge rows."""

import hashlib
import random
from functools import cache
from itertools import product
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from ledgerbeam.llm import chat_repair as cr


def cheapest(symbols):
    """(cost, audit) by trying every edit in every place; the order of tuples settles ties."""

    @cache
    def best(i, q):  # q: outputs so far end in "", s, u or a
        found = []
        if i == len(symbols) and q in ("", "a"):
            found.append((0, ""))
        then = {"": "su", "s": "u", "u": "a", "a": "u"}[q]
        if i < len(symbols):
            s = symbols[i]
            found.append((4 + best(i + 1, q)[0], "D" + best(i + 1, q)[1]))
            if s is not None:
                more = 3 if s[1] else 0
                if s[0] in then:
                    found.append((more + best(i + 1, s[0])[0], "K" + best(i + 1, s[0])[1]))
                for role in set(then) & {"u", "a"}:
                    found.append((3 + more + best(i + 1, role)[0], "R" + best(i + 1, role)[1]))
        for role in set(then) & {"u", "a"}:
            cost, said = inserted(i, role, 3)
            found.append((3 + cost, "I" + said))
        return min(found)

    @cache
    def inserted(i, q, left):  # up to `left` insertions in a row are enough; more only go round
        found = []
        if i == len(symbols) and q == "a":
            found.append((0, ""))
        if i < len(symbols):
            s, then = symbols[i], {"u": "a", "a": "u"}[q]
            found.append((4 + best(i + 1, q)[0], "D" + best(i + 1, q)[1]))
            if s is not None:
                more = 3 if s[1] else 0
                if s[0] == then:
                    found.append((more + best(i + 1, then)[0], "K" + best(i + 1, then)[1]))
                found.append((3 + more + best(i + 1, then)[0], "R" + best(i + 1, then)[1]))
        if left:
            cost, said = inserted(i, {"u": "a", "a": "u"}[q], left - 1)
            found.append((3 + cost, "I" + said))
        return min(found) if found else (10**6, "")

    return best(0, "")


def by_tables(symbols, cuts=()):
    """(cost, audit) by the tables, over runs that are cut at `cuts`."""
    codes = bytes(cr.SYMBOLS.index(s) for s in symbols)
    bounds = [0, *sorted(cuts), len(codes)]
    runs = [codes[a:b] for a, b in zip(bounds, bounds[1:])]
    row = {"runs": []}
    for i, run in enumerate(runs):
        to, added = cr.run_map(run)
        row["runs"].append({"part": i, "to": to.tolist(), "added": added.tolist()})
    back = cr._chain_back(row)
    ends = {b["part"]: b["end"] for b in back}
    state, said = 0, ""
    for i, run in enumerate(runs):
        letters, state = cr.trace(run, ends[i], state)
        said += "".join(letters)
    return back[0]["cost"], said + cr.FINISH[state]


@pytest.mark.parametrize("n", range(5))
def test_tables_equal_all_edits(n):
    for symbols in product(cr.SYMBOLS, repeat=n) if n < 4 else (random.Random(n).choices(cr.SYMBOLS, k=n + i % 9) for i in range(1500)):
        assert by_tables(symbols) == cheapest(symbols), symbols


def test_runs_chain():
    rng = random.Random(3)
    for _ in range(300):
        symbols = rng.choices(cr.SYMBOLS, k=rng.randint(0, 40))
        cuts = [rng.randint(0, len(symbols)) for _ in range(rng.randint(0, 6))]
        assert by_tables(symbols, cuts) == by_tables(symbols)
    assert len(cr.tables()["vectors"]) < 100


ROWS = [
    (1, 0, "system", "s."), (1, 1, "user", "Why?"), (1, 2, "assistant", "cut off"), (1, 3, "assistant", "more."), (1, 4, None, None),
    (2, 0, "assistant", "a."), (2, 0, "assistant", "a."), (2, None, "user", "null turn."), (2, 9, "user", "null turn."),
    (3, None, "user", ""), (4, 1, "tool", "t!"), (4, 2, "", "no role."), (None, 1, "user", "u."), (None, 2, "assistant", "a."), (None, None, None, "x"),
    (5, 3, "system", "only."), (-7, -2, "user", "minus.\n"), (-7, 2, "assistant", " \t\n"),
]
ROWS += [(100, i, rng_role, f"text {i % 900}.") for i, rng_role in enumerate(random.Random(5).choices(["user", "assistant", "system", "tool"], k=3000))]
ROWS += [(101, 7, "user", "same.")] * 500
ROWS += [(102, i % 3, "assistant" if i % 2 else "user", "long " * 40_000 + str(i)) for i in range(6)]
DDL = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("merge", ["true", "false"])
def test_query_on_edge_rows(spark, tmp_path, merge):
    """With partitions left as dealt, the long conversation is in several runs."""
    spark.createDataFrame(ROWS, DDL).withColumn("audit", F.lit(1)).withColumn("n", F.lit("clash")).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, merge)
    try:
        found = cr.op13_repair_chats(spark, str(tmp_path)).collect()
        parts = cr.ordered(spark.createDataFrame(ROWS, DDL)).where("conv_id = 100").select("part").distinct().count()
    finally:
        spark.conf.unset(name)
    assert (parts > 1) == (merge == "false")
    assert sorted(map(str, (r[0] for r in found))) == sorted(map(str, {r[0] for r in ROWS}))
    for r in found:
        assert tuple(r) == plain(r["conv_id"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "conversations.parquet"))
    assert cr.op13_repair_chats(spark, str(tmp_path)).count() == 0


def plain(conv_id):
    """The contract's row of one conversation, by loops."""
    blank = lambda v: " " if v is None else v
    rows = []
    for c, turn, role, text in ROWS:
        if c != conv_id:
            continue
        k, role, text = crc32(f"{blank(c)}:{blank(turn)}".encode()) % 20, blank(role), blank(text)
        if k == 0:
            continue
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        rows += [(turn is not None, turn or 0, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    rows.sort(key=lambda r: (r[0], r[1], r[2], r[3]))
    white, seen, faults, symbols = " \t\n\x0b\x0c\r", set(), [], []
    for _, _, role, text in rows:
        said = text.rstrip(white)
        faults.append("blank" if not said.strip(white) else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols.append(None if faults[-1] in ("blank", "duplicate") else (letter, faults[-1] == "truncated"))
    turns = {r[1] for r in rows if r[0]}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = cheapest(symbols) if len(symbols) < 200 else by_tables(symbols)
    lines, i, last = [], 0, ""
    for x in audit:
        role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        if x == "K":
            lines.append(f"{rows[i][2]}:{rows[i][3]}")
            role = rows[i][2]
        elif x != "D":
            lines.append(f"{role}:{rows[i][3] if x == 'R' else ''}")
        last = last if x == "D" else role[0]
        i += x != "I"
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return conv_id, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha
