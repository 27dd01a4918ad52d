"""Chat formatting: a declarative template, a role machine, and segments with loss flags. DataFrame work only.

A template names for each role the control text before and after a turn and whether its text counts for the
loss. Texts are escaped so that no control string of any common template survives in them: a backslash is put
after every `<`, `[`, `|` and backslash, which is undone exactly by dropping the backslash after each of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may follow what; "" stands for the start of a conversation.
TURNS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}


@dataclass(frozen=True)
class Template:
    """Control strings of a chat format. Each starts with `<|`, so escaped text can't hold one."""

    open: str = "<|turn|>"
    text: str = "<|text|>"
    close: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: TURNS)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[<\[|\\]", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[|\\])\\", "$1")


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conv_id: segments, formatted, valid, bad_turn.

    `turns` has conv_id, turn, role, text; more columns are ignored. Turns come in order of turn, then role and
    text, null first, so repeated turns have one order. Null role or text counts as empty; a null conv_id is a
    conversation of its own. A segment is (text, loss); their texts joined are `formatted`. The role machine
    accepts what `template.turns` allows; `bad_turn` is the index of the first turn it rejects, null if none.
    A conversation is one row, so a very long one needs the memory of its own text a few times over; Spark's
    limit for a row, 2 GB, is a conversation's. Empty tables give empty results.
    """
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    per_turn = F.transform(
        "rows",
        lambda r: F.array(
            segment(F.concat(F.lit(template.open), escape(r["role"]), F.lit(template.text)), F.lit(False)),
            segment(escape(r["text"]), r["role"].isin(*template.loss_roles)),
            segment(F.lit(template.close), F.lit(False)),
        ),
    )
    allowed = F.create_map(*[x for role, then in template.turns.items() for x in (F.lit(role), F.array(*map(F.lit, then)))])
    start = F.struct(F.lit("").alias("at"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))

    def advance(state: Column, r: Column) -> Column:
        fits = F.coalesce(F.array_contains(F.try_element_at(allowed, state["at"]), r["role"]), F.lit(False))
        return F.struct(
            r["role"].alias("at"),
            (state["i"] + 1).alias("i"),
            F.coalesce(state["bad"], F.when(~fits, state["i"])).alias("bad"),
        )

    return rows.select(
        "conv_id",
        F.flatten(per_turn).alias("segments"),
        F.aggregate("rows", start, advance, lambda end: end["bad"]).alias("bad_turn"),
    ).select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("bad_turn").isNull().alias("valid"),
        "bad_turn",
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns, as an array of (role, text), read back from a formatted conversation."""
    literal = lambda s: r"\Q" + s + r"\E"
    parts = F.filter(F.split(formatted, literal(template.close)), lambda p: p != "")
    halves = F.transform(parts, lambda p: F.split(F.substr(p, F.lit(len(template.open) + 1)), literal(template.text)))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def op6_format_chats(spark, sf_dir):
    """Contract query: digests of every conversation, all read back from the formatted output."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    chats = format_chats(given.unionByName(extra))
    lost = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.select("conv_id", "formatted", "valid", "bad_turn", lost.alias("lost"), read_turns(F.col("formatted")).alias("turns"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )


ORACLE_OP6 = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, row_number() OVER w - 1 AS i, coalesce(lag(role) OVER w, '') AS before FROM given
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), said AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS lost,
    sum(23 + length(regexp_replace(role, '[<\[|\\]', 'xx', 'g')) + length(regexp_replace(text, '[<\[|\\]', 'xx', 'g'))
    )::BIGINT AS formatted_chars,
    min(i) FILTER (NOT CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
      WHEN 'assistant' THEN role IN ('user', 'tool') WHEN 'tool' THEN role = 'assistant' ELSE false END)::INT AS bad_turn
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(lost)::BIGINT AS loss_chars,
  sha256(lost) AS loss_sha256, formatted_chars, bad_turn IS NULL AS valid, bad_turn FROM said
"""
