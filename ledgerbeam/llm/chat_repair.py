"""Conversation structure repair: cheapest edits by a table of cost-vector transitions for whole blocks of rows.

What remains to be paid from each state of the role machine is a vector of four costs. Less its least entry, only a
few such vectors exist, so what a block of BLOCK rows does to each of them is looked up in a table. Blocks are taken
from the end to the start; then each block is expanded backward from the vector at its end, and the edits are read
forward: of those that keep the cost least, the one whose initial comes first. So ties are settled as asked.

Rows are dealt by ranges of conversation and turn, and what lies in one task of one conversation is a run. A run is a
map from the vector at its end to the one at its start, and from a state to a state. These maps are small and chain
over the runs of a conversation, so a conversation may be spread over any number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ledgerbeam.llm.common import cut, release, table

#: Rows that one look at the table covers.
BLOCK = 3

#: States: start, after system, after user, after assistant; an insertion always adds the one role that may follow.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT_ROLE = ("user", "user", "assistant", "user")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Symbols of rows: 0 has to go; then by initial, whole ones before truncated ones.
SYMBOLS = [None, *[(c, cut_off) for cut_off in (False, True) for c in ("s", "u", "a", "o")]]


def _with_inserts(w: tuple) -> tuple:
    """The least costs where any number of insertions may come first."""
    v = list(w)
    for _ in range(3):
        v = [min(v[q], INSERT + v[STEP[q, NEXT_ROLE[q][0]]]) for q in range(4)]
    return tuple(v)


def _options(symbol, q: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits that take a row, in the order of their initials."""
    yield "D", DELETE, q
    if symbol:
        extra = TRUNCATED if symbol[1] else 0
        if (q, symbol[0]) in STEP:
            yield "K", extra, STEP[q, symbol[0]]
        yield "R", REROLE + extra, STEP[q, NEXT_ROLE[q][0]]


@cache
def tables() -> dict:
    """All normalised vectors, what one row and one block does to them, and the edits from each state."""
    infinite = 10**9
    end = _with_inserts((0, infinite, infinite, 0))
    vectors, single = [tuple(c - min(end) for c in end)], {}
    at = {vectors[0]: 0}
    for v in vectors:  # grows until no row leads to a new one
        for k, symbol in enumerate(SYMBOLS):
            w = _with_inserts(tuple(min(cost + v[to] for _, cost, to in _options(symbol, q)) for q in range(4)))
            least = min(w)
            new = tuple(c - least for c in w)
            if new not in at:
                at[new] = len(vectors)
                vectors.append(new)
            single[at[v], k] = at[new], least
    to = np.array([[single[v, k][0] for k in range(len(SYMBOLS))] for v in range(len(vectors))], np.int64)
    add = np.array([[single[v, k][1] for k in range(len(SYMBOLS))] for v in range(len(vectors))], np.int64)
    blocks = len(SYMBOLS) ** BLOCK
    block_to, block_add = np.zeros((len(vectors), blocks), np.int64), np.zeros((len(vectors), blocks), np.int64)
    for code, symbols in enumerate(product(range(len(SYMBOLS)), repeat=BLOCK)):
        v, cost = np.arange(len(vectors)), 0
        for k in reversed(symbols):
            cost = cost + add[v, k]
            v = to[v, k]
        block_to[:, code], block_add[:, code] = v, cost
    moves = {}
    for (v, k), (new, least), q in ((*x, q) for x in single.items() for q in range(4)):
        state, said = q, ""
        while True:  # insertions before the row cost something, so this ends
            left = vectors[new][state] + least
            tied = [(c, s) for c, cost, s in _options(SYMBOLS[k], state) if cost + vectors[v][s] == left]
            inserted = STEP[state, NEXT_ROLE[state][0]]
            if INSERT + vectors[new][inserted] == vectors[new][state]:
                tied.append(("I", inserted))
            letter, state = min(tied)
            said += letter
            if letter != "I":
                break
        moves[v, k, q] = said, state
    return {"vectors": vectors, "to": to, "add": add, "block_to": block_to, "block_add": block_add, "moves": moves}


#: What is inserted after the last row.
FINISH = ("", "II", "I", "")


def run_map(symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each vector at the end of a run: the vector at its start, and what the run adds to all of its entries."""
    t, n = tables(), len(symbols)
    v, cost = np.arange(len(t["vectors"])), np.zeros(len(t["vectors"]), np.int64)
    head = n % BLOCK
    codes = np.frombuffer(symbols, np.uint8)[head:].reshape(-1, BLOCK) @ (len(SYMBOLS) ** np.arange(BLOCK - 1, -1, -1))
    for code in codes[::-1]:
        cost += t["block_add"][v, code]
        v = t["block_to"][v, code]
    for k in reversed(symbols[:head]):
        cost += t["add"][v, k]
        v = t["to"][v, k]
    return v, cost


def trace(symbols: bytes, end: int, state: int) -> tuple[list[str], int]:
    """Edits of each row of a run that has vector `end` behind it and starts in `state`, and the state it ends in."""
    t, n = tables(), len(symbols)
    to, moves = t["to"], t["moves"]
    behind = [0] * n  # the vector behind each row: at the ends of blocks from the table, inside by expanding
    v, stop = end, n
    while stop:
        start = max(stop - BLOCK, 0)
        inner = v
        for i in range(stop - 1, start - 1, -1):
            behind[i] = inner
            inner = int(to[inner, symbols[i]])
        if stop - start == BLOCK:
            code = 0
            for k in symbols[start:stop]:
                code = code * len(SYMBOLS) + k
            v = int(t["block_to"][v, code])
        stop = start
    said = []
    for i in range(n):
        letters, state = moves[behind[i], symbols[i], state]
        said.append(letters)
    return said, state


def _arrow(df: DataFrame, schema: str, per_row) -> DataFrame:
    """Rows that `per_row` makes of each row of `df`, as dicts by name; conv_id stays an Arrow column."""
    out = StructType([df.schema["conv_id"], *StructType.fromDDL(schema)])
    names = out.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(f.dataType) for f in out][1:]
        for b in batches:
            taken, made = [], []
            for i, row in enumerate(b.to_pylist()):
                for got in per_row(row):
                    taken.append(i)
                    made.append(got)
            ids = b.column("conv_id").take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([m[n] for m in made], k) for n, k in zip(names, kinds)]], ["conv_id", *names])

    return df.mapInArrow(run, out)


BLANK = r"^[\x20\x09-\x0D]*\z"
CUT_OFF = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"


def ordered(turns: DataFrame) -> DataFrame:
    """A written table of the rows in order: conv_id, part, pos, turn, role, text, n, fault, symbol, initial.

    `turns` has conv_id, turn, role, text and, if equal rows are to count several times, n; more columns are ignored.
    Null role and text are one space. Rows of a conversation come by turn, role, text, null first. Equal rows are one
    row here, that counts n times and of which all but the first are duplicates. `fault` is the first row's.
    """
    blank = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    n = F.col("n") if "n" in turns.columns else F.lit(1)
    rows = turns.select("conv_id", "turn", blank("role"), blank("text"), n.cast("long").alias("n"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("said", F.sha2(F.concat_ws("\0", F.length("role"), "role", "text"), 256))
    sooner = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min(sooner)["turn"].alias("first"))
    both = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")))
    fault = (
        F.when(F.col("text").rlike(BLANK), "blank")
        .when(~F.col("turn").eqNullSafe(F.col("first")), "duplicate")
        .when(F.col("text").rlike(CUT_OFF), "truncated")
        .otherwise("")
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    of_letter = F.element_at(F.create_map(*[F.lit(x) for pair in (("s", 1), ("u", 2), ("a", 3), ("o", 4)) for x in pair]), letter)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), 0).when(F.col("fault") == "truncated", of_letter + 4).otherwise(of_letter)
    marked = both.withColumn("fault", fault).withColumn("symbol", symbol.cast("int")).withColumn("initial", letter)
    sort = ["conv_id", "turn", "role", "text"]
    dealt = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*sort)
    return cut(dealt.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", "n", "fault", "symbol", "initial"))


def _symbols(row: dict) -> bytes:
    return b"".join(bytes([r["symbol"]]) + b"\0" * (r["n"] - 1) for r in row["rows"])


def _chain_back(row: dict) -> list[dict]:
    """The vector behind each run of a conversation, from the last to the first, and the conversation's cost."""
    vectors, v, cost, out = tables()["vectors"], 0, 0, []
    for r in reversed(row["runs"]):
        out.append({"part": r["part"], "end": v})
        cost += r["added"][v]
        v = r["to"][v]
    return [o | {"cost": cost + vectors[v][0]} for o in out]


def _chain_on(row: dict) -> list[dict]:
    state, out = 0, []
    for i, r in enumerate(row["runs"]):
        out.append({"part": r["part"], "state": state, "last": i + 1 == len(row["runs"])})
        state = r["states"][state]
    return out


def _edits(row: dict) -> list[dict]:
    """One row for each row of a run: its audit, and the roles of the lines it leaves ("" for its own); at the end what follows."""
    said, _ = trace(_symbols(row), row["end"], row["state"])
    state, at, out = row["state"], 0, []
    for r in row["rows"]:
        letters, roles = "".join(said[at : at + r["n"]]), []
        at += r["n"]
        for x in letters:
            if x == "K":
                roles.append("")
                state = STEP[state, r["initial"]]
            elif x != "D":
                roles.append(("+" if x == "I" else "") + NEXT_ROLE[state])
                state = STEP[state, NEXT_ROLE[state][0]]
        out.append({"part": row["part"], "pos": r["pos"], "audit": letters, "lines": roles})
    if row["last"]:
        for _ in FINISH[state]:
            out[-1]["audit"] += "I"
            out[-1]["lines"].append("+" + NEXT_ROLE[state])
            state = STEP[state, NEXT_ROLE[state][0]]
    return out


def plan_edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, costs) of the rows from `ordered`.

    Edits have conv_id, part, pos, audit and lines: what a row leaves, "" for itself, a role for itself under that
    role, and "+role" for an inserted line. Costs have conv_id and cost. Both are written tables. A run is held by one
    task without its texts; of a conversation one task holds a few hundred numbers for each run.
    """
    items = F.array_sort(F.collect_list(F.struct("pos", "symbol", "n", "initial")))
    runs = cut(rows.groupBy("conv_id", "part").agg(items.alias("rows")))

    def maps(row):
        v, cost = run_map(_symbols(row))
        return [{"part": row["part"], "to": v.tolist(), "added": cost.tolist()}]

    def states(row):
        found = _symbols(row)
        return [{"part": row["part"], "states": [trace(found, row["end"], q)[1] for q in range(4)]}]

    in_order = lambda *names: F.array_sort(F.collect_list(F.struct("part", *names))).alias("runs")
    mapped = _arrow(runs, "part int, to array<int>, added array<long>", maps)
    behind = cut(_arrow(mapped.groupBy("conv_id").agg(in_order("to", "added")), "part int, end int, cost long", _chain_back))
    key = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["part"] == b["part"])
    known = runs.join(behind, key(runs, behind)).select(runs["conv_id"], runs["part"], "rows", "end")
    moved = _arrow(known, "part int, states array<int>", states)
    starts = cut(_arrow(moved.groupBy("conv_id").agg(in_order("states")), "part int, state int, last boolean", _chain_on))
    whole = known.join(starts, known["conv_id"].eqNullSafe(starts["conv_id"]) & (known["part"] == starts["part"]))
    whole = whole.select(known["conv_id"], known["part"], "rows", "end", "state", "last")
    edits = cut(_arrow(whole, "part int, pos long, audit string, lines array<string>", _edits))
    costs = cut(behind.select("conv_id", "cost").distinct())
    release(runs, behind, starts)
    return edits, costs


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, pos, audit, lines) with lines as an array of (role, text), in order of pos for each conversation."""
    e = edits.select(F.col("pos").alias("p"), "audit", "lines")
    line = lambda r: F.when(r == "", F.struct("role", "text")).when(
        r.startswith("+"), F.struct(F.substr(r, F.lit(2)).alias("role"), F.lit("").alias("text"))
    ).otherwise(F.struct(r.alias("role"), "text"))
    return rows.join(e, F.col("pos") == F.col("p")).select("conv_id", "pos", "audit", F.transform("lines", line).alias("lines"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows as the contract damages them, with n = 2 where one is repeated. Null ids and turns count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("k <> 0").select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).alias("n")
    )


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of what `repaired` gives.

    A digest runs over a conversation's text from its start to its end, so one task reads each conversation; it
    streams and holds one batch.
    """
    joined = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    flat = lines.select("conv_id", "pos", "audit", (F.size("lines") > 0).alias("some"), joined.alias("said"))
    out = StructType([flat.schema["conv_id"], *StructType.fromDDL("audit string, repaired_sha256 string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, audit, fresh = None, None, [], True
        for b in batches:
            ids, at = b.column(0), []
            audits, digests = [], []
            for conv, letters, some, said in zip(ids.to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if sha is None or conv != current:
                    if sha is not None:
                        at.append(current), audits.append("".join(audit)), digests.append(sha.hexdigest())
                    current, sha, audit, fresh = conv, hashlib.sha256(), [], True
                audit.append(letters)
                if some:
                    sha.update((said if fresh else "\n" + said).encode())
                    fresh = False
            yield pa.RecordBatch.from_arrays([pa.array(at, ids.type), pa.array(audits, pa.string()), pa.array(digests, pa.string())], out.names)
            kind = ids.type
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], out.names)

    return flat.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, out)


def tallies(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal) of the rows from `ordered`.

    Neighbours within a part are seen by a window over each run; those of two runs by one over runs.
    """
    count = lambda f: F.sum(F.when(F.col("fault") == f, 1).otherwise(0)).cast("long").alias(f)
    again = F.sum(F.when(F.col("fault") != "blank", F.col("n") - 1).otherwise(0))
    blanks = F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).cast("long").alias("blank")
    fits = lambda pair: pair.isin("su", "ua", "au")
    run = W.partitionBy("conv_id", "part").orderBy("pos")
    before = F.lag("initial").over(run)
    seen = rows.withColumn("off", F.when(before.isNotNull() & ~fits(F.concat(before, "initial")), 1).otherwise(0) + F.col("n") - 1)
    per_run = seen.groupBy("conv_id", "part").agg(
        blanks, (count("duplicate") + again).alias("duplicate"), count("truncated"), F.sum("off").alias("off"),
        F.min_by("initial", "pos").alias("head"), F.max_by("initial", "pos").alias("tail"),
    )
    ahead = F.lag("tail").over(W.partitionBy("conv_id").orderBy("part"))
    edge = F.when(ahead.isNotNull() & ~fits(F.concat(ahead, "head")), 1).otherwise(0)
    faults = per_run.withColumn("edge", edge).groupBy("conv_id").agg(
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"), F.sum(F.col("off") + F.col("edge")).alias("illegal")
    )
    turns = rows.groupBy(F.col("conv_id").alias("c")).agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    return faults.join(turns, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal")


def op13_repair_chats(spark, sf_dir):
    """Contract query: damaged conversations, their faults, and the cheapest repair of each.

    Ids that are null are one conversation. Rows of one turn come by role and text, so repeats are adjacent. Of a
    conversation without rows after damage all counts are 0, the audit is empty and the digest that of no text.
    """
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = ordered(damage(given))
    edits, costs = plan_edits(rows)
    said, counted = digests(repaired(rows, edits)), tallies(rows)
    everyone = given.select("conv_id").distinct()
    out = everyone
    for more in (counted, costs, said):
        other = more.withColumnRenamed("conv_id", "c")
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", zero("gaps"), zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


_INS = [STEP[q, NEXT_ROLE[q][0]] for q in range(4)]
_EDITED = ", ".join(
    f"list_min(list_filter([{{'c': 4 + v[{q + 1}].c, 'a': 'D' || v[{q + 1}].a}}, "
    f"CASE WHEN ok AND ({' OR '.join(f'''initial = '{c}' ''' for (p, c) in STEP if p == q)}) THEN {{'c': extra + v[CASE initial {' '.join(f'''WHEN '{c}' THEN {to + 1}''' for (p, c), to in STEP.items() if p == q)} ELSE 1 END].c, "
    f"'a': 'K' || v[CASE initial {' '.join(f'''WHEN '{c}' THEN {to + 1}''' for (p, c), to in STEP.items() if p == q)} ELSE 1 END].a}} END, "
    f"CASE WHEN ok THEN {{'c': 3 + extra + v[{_INS[q] + 1}].c, 'a': 'R' || v[{_INS[q] + 1}].a}} END], lambda o: o IS NOT NULL))"
    for q in range(4)
)
_OPENED = ", ".join(
    f"list_min([w[{q + 1}], {{'c': 3 + w[{_INS[q] + 1}].c, 'a': 'I' || w[{_INS[q] + 1}].a}}, {{'c': 6 + w[{_INS[_INS[q]] + 1}].c, 'a': 'II' || w[{_INS[_INS[q]] + 1}].a}}])"
    for q in range(4)
)

#: One step of the recursion for each row, from the last to the first, with the best audit from each state.
ORACLE_OP13 = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
summed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(name, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS k FROM given),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
  CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) FROM summed WHERE k <> 0),
placed AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER w AS i, left(lag(role) OVER w, 1) AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
  WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM again),
r AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM faulty),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
back AS (
  SELECT conv_id, n AS i, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS v FROM counted
  UNION ALL SELECT conv_id, i - 1, [{_OPENED}] FROM (
    SELECT back.conv_id, back.i, [{_EDITED}] AS w FROM back JOIN r ON r.conv_id IS NOT DISTINCT FROM back.conv_id AND r.i = back.i)),
best AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM back WHERE i = 0),
letters AS (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS j, audit FROM best),
edits AS (SELECT conv_id, substr(audit, j, 1) AS l, sum(CASE WHEN substr(audit, j, 1) <> 'I' THEN 1 ELSE 0 END) OVER w AS i,
  sum(CASE WHEN substr(audit, j, 1) <> 'D' THEN 1 ELSE 0 END) OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
matched AS (SELECT e.conv_id, l, o, r.role, r.text, max(CASE WHEN l = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS shift
  FROM edits e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i AND l <> 'I' WHERE l <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role ELSE CASE WHEN (o - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, ''), chr(10) ORDER BY o) AS t
  FROM matched GROUP BY 1)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM given) g LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM g.conv_id
"""
