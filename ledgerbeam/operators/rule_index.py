"""Ordered rules by the hundred thousand: an inverted index of each rule's rarest piece, and a check of what it brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbeam.operators.rules import classify, rules_from_table

#: What ends a token.
BETWEEN = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Characters of a token's part that are looked up; longer parts are cut to that.
LONGEST = 12


def _tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, BETWEEN), "")


def _rule_keys(kind: Column, pattern: Column) -> Column:
    """Pieces that every matching line has: whole tokens, and beginnings, ends or parts of those at the pattern's edges."""
    tokens = _tokens(pattern)
    n = F.size(tokens)
    open_left = kind.isin("contains", "endswith") & pattern.rlike(r"^[0-9A-Za-z\x{80}-\x{10FFFF}]")
    open_right = kind.isin("contains", "startswith") & pattern.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]\z")
    part = lambda t: F.substr(t, F.lit(1), F.lit(LONGEST))

    def of(t: Column, i: Column) -> Column:
        left, right = open_left & (i == 0), open_right & (i == n - 1)
        return (
            F.when(left & right, F.concat(F.lit("g"), part(t)))
            .when(left, F.concat(F.lit("s"), F.right(t, F.lit(LONGEST))))
            .when(right, F.concat(F.lit("p"), part(t)))
            .otherwise(F.concat(F.lit("t"), t))
        )

    return F.when(kind == "regex", F.array().cast("array<string>")).otherwise(F.transform(tokens, of))


def _parts(t: Column, n: int) -> Column:
    """All parts of `n` characters; null in shorter tokens."""
    starts = F.sequence(F.lit(1), F.length(t) - n + 1)
    return F.when(F.length(t) >= n, F.transform(starts, lambda i: F.concat(F.lit("g"), F.substr(t, i, F.lit(n)))))


def _line_keys(text: Column, lengths: dict[str, list[int]]) -> Column:
    """All pieces of a line that some rule may ask for."""

    def of(t: Column) -> Column:
        whole = [F.concat(F.lit("t"), t)]
        cuts = [F.when(F.length(t) >= n, F.concat(F.lit("p"), F.left(t, F.lit(n)))) for n in lengths["p"]]
        cuts += [F.when(F.length(t) >= n, F.concat(F.lit("s"), F.right(t, F.lit(n)))) for n in lengths["s"]]
        return F.concat(F.array(*whole, *cuts), *[F.coalesce(_parts(t, n), F.array().cast("array<string>")) for n in lengths["g"]])

    return F.array_distinct(F.array_compact(F.flatten(F.transform(_tokens(text), of))))


def classify_indexed(lines: DataFrame, column: str, rules: DataFrame, default: str, name: str) -> DataFrame:
    """`lines` with `name`: the result of the first rule that matches `column`, `default` if none does.

    `rules` has (priority, kind, pattern, result) with the kinds of `rules.Rule`, and may be as large as a table is.
    Each rule is found by that of its pieces which the fewest lines have, by an equi-join, and then checked; so a
    line meets only rules that share a rare piece with it. Lines with equal texts are classified once. Of equal
    priorities the pattern that sorts first decides, and of equal patterns the result. Regular expressions and patterns without letters or digits
    have no piece: these stay one expression and have to be few (`rules.MOST_RULES`). Null texts match nothing.
    """
    texts = lines.select(F.col(column).alias("_text")).where("_text is not null").distinct()
    keyed = rules.withColumn("_keys", _rule_keys(F.col("kind"), F.col("pattern")))
    pieces = keyed.where(F.size("_keys") > 0).select("priority", "kind", "pattern", "result", F.explode(F.array_distinct("_keys")).alias("_key"))
    used = pieces.select(F.left("_key", F.lit(1)).alias("k"), (F.length("_key") - 1).alias("n")).where("k <> 't'").distinct().collect()  # at most 3 * LONGEST
    lengths = {k: sorted(r["n"] for r in used if r["k"] == k) for k in "psg"}
    met = texts.select("_text", F.explode(_line_keys(F.col("_text"), lengths)).alias("_key"))
    often = met.join(pieces.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_often"))
    rated = pieces.join(often, "_key")  # a piece that no line has rules its rule out
    missing = pieces.join(often, "_key", "left_anti").select("priority", "kind", "pattern", "result").distinct()
    rarest = rated.join(missing, ["priority", "kind", "pattern", "result"], "left_anti").groupBy("priority", "kind", "pattern", "result").agg(F.min(F.struct("_often", "_key")).alias("_r"))
    found = met.join(rarest.select("priority", "kind", "pattern", "result", F.col("_r._key").alias("_key")), "_key")
    text, pattern = F.col("_text"), F.col("pattern")
    holds = (
        F.when(F.col("kind") == "contains", F.contains(text, pattern))
        .when(F.col("kind") == "startswith", F.startswith(text, pattern))
        .when(F.col("kind") == "endswith", F.endswith(text, pattern))
        .otherwise(text == pattern)
    )
    first = found.where(holds).groupBy("_text").agg(F.min(F.struct("priority", "pattern", "result")).alias("_first"))
    few = keyed.where(F.size("_keys") == 0)
    plain = few.withColumn("result", F.concat_ws("\0", F.lpad(F.col("priority").cast("string"), 20, " "), "pattern", "result"))
    other = classify(rules_from_table(plain.select("priority", "kind", "pattern", "result"), "_text"), "")
    both = texts.join(first, "_text", "left").withColumn("_other", F.split(other, "\0"))
    of_other = F.struct(F.trim(F.get("_other", F.lit(0))).cast(rules.schema["priority"].dataType).alias("priority"), F.get("_other", F.lit(1)).alias("pattern"), F.get("_other", F.lit(2)).alias("result"))
    best = F.array_min(F.array_compact(F.array(F.col("_first"), F.when(F.size("_other") == 3, of_other))))
    chosen = both.select("_text", best["result"].alias(name))
    return lines.join(chosen, F.col(column) == F.col("_text"), "left").drop("_text").withColumn(name, F.coalesce(name, F.lit(default)))
