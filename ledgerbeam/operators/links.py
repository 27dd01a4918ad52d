"""Links between cells: the references of formulas as a table, those that lead nowhere, and all that depends on a change."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerbeam.functions.refs import references_of
from ledgerbeam.sources.scratch import cut

#: Rows of a block; a range meets cells block by block.
BLOCK = 4096
#: Targets, or formulas, of a partition; a target that more formulas name is dealt in parts.
PART = 100_000
PLACE = ["sheet", "row", "col"]
TARGET = ["to_sheet", "first_row", "last_row", "first_col", "last_col"]


def column_number(letters: Column) -> Column:
    """1 for A, 27 for AA."""
    return F.aggregate(F.array_remove(F.split(letters, ""), ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def references(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, token, to_sheet, first_row, last_row, first_col, last_col): one row for each reference of a formula.

    `cells` has (sheet, row, col, value); formulas are values that begin with "=". Rows are null in whole columns.
    References inside quoted text are none; one that a formula names twice is there twice. Nothing is evaluated.
    """
    found = cells.where(F.col("value").startswith("=")).select(*PLACE, F.explode(references_of(F.col("value"), F.col("sheet"))).alias("r"))
    corner = lambda i: F.element_at("r.fields.corners", i)
    span = lambda f, field: f(field(corner(1)), field(corner(-1)))
    number = lambda c: column_number(F.replace(c["col"], F.lit("$"), F.lit("")))
    row = lambda c: c["row"]
    return found.select(
        *PLACE, F.col("r.token").alias("token"), F.col("r.fields.sheet").alias("to_sheet"),
        span(F.least, row).alias("first_row"), span(F.greatest, row).alias("last_row"), span(F.least, number).alias("first_col"), span(F.greatest, number).alias("last_col"),
    )


def _blocks(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("sheet").alias("to_sheet"), F.col("col").alias("_c"), F.floor(F.col("row") / BLOCK).alias("_b")).distinct()


def _covered(ranges: DataFrame, cells: DataFrame) -> DataFrame:
    """`ranges` with the places _s, _r, _c of the `cells` in them: joined by sheet, column and block of rows.

    A range is copied once for each of its columns and each block of them that holds a cell, so a whole column costs
    as many rows as it has blocks. Columns of a range are bounded by a sheet's own.
    """
    wide = ranges.withColumn("_c", F.explode(F.sequence("first_col", "last_col")))
    within = (F.col("first_row").isNull() | ((F.col("_b") >= F.floor(F.col("first_row") / BLOCK)) & (F.col("_b") <= F.floor(F.col("last_row") / BLOCK))))
    dealt = wide.join(_blocks(cells), ["to_sheet", "_c"]).where(within)
    at = cells.select(F.col("sheet").alias("to_sheet"), F.col("col").alias("_c"), F.floor(F.col("row") / BLOCK).alias("_b"), F.col("row").alias("_r"))
    met = dealt.join(at, ["to_sheet", "_c", "_b"])
    return met.where(F.col("first_row").isNull() | ((F.col("_r") >= F.col("first_row")) & (F.col("_r") <= F.col("last_row")))).drop("_b")


def dangling(cells: DataFrame, removed: list[str] | None = None) -> DataFrame:
    """References that lead nowhere once the sheets `removed` are gone, with `reason`: removed sheet, no sheet, no cell.

    A range counts as found if any cell is in it. Formulas of removed sheets are gone too. Each distinct target is
    looked up once, however many formulas name it.
    """
    gone = F.col("sheet").isin(removed) if removed else F.lit(False)
    left = cells.where(~gone)
    links = references(left)
    targets = links.select(*TARGET).distinct()
    sheets = left.select(F.col("sheet").alias("to_sheet"), F.lit(True).alias("_sheet")).distinct()
    filled = _covered(targets, left).select(*TARGET).distinct().withColumn("_filled", F.lit(True))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in TARGET]
    known = links.alias("l").join(filled.alias("r"), same, "left").select("l.*", "_filled").join(sheets, "to_sheet", "left")
    was_there = F.col("to_sheet").isin(removed) if removed else F.lit(False)
    reason = F.when(was_there, "removed sheet").when(F.col("_sheet").isNull(), "no sheet").otherwise("no cell")
    return known.where("_filled is null").select(*PLACE, "token", "to_sheet", reason.alias("reason"))


def _pieces(ranges: DataFrame) -> DataFrame:
    """`ranges` with (_c, _level, _block): their rows as few blocks of 2^level rows, aligned, for each of their columns.

    The level of whole columns is -1. A place is in one block of each level, so what holds a place is found by equality.
    """
    far = F.lit(1 << 60)  # no sheet has that many rows
    within = ranges.withColumns({"_a": F.least("first_row", far), "_z": F.least("last_row", far)})
    one = F.expr("array(struct(0 AS _level, _a AS _block))")
    ends = "filter(transform(sequence(0, length(bin(_z - _a + 1)) - 1), j -> struct(j, shiftright(_a + shiftleft(1L, j) - 1, j) AS l, shiftright(_z + 1, j) AS r)), x -> x.l < x.r)"
    several = F.expr(f"flatten(transform({ends}, x -> array_compact(array(IF(x.l % 2 = 1, struct(x.j AS _level, x.l AS _block), NULL), IF(x.r % 2 = 1, struct(x.j AS _level, x.r - 1 AS _block), NULL)))))")
    blocks = F.when(F.col("_a") < 0, F.expr("array(struct(-1 AS _level, 0L AS _block))")).when(F.col("_a") == F.col("_z"), one).otherwise(several)
    wide = within.withColumn("_c", F.explode(F.sequence("first_col", "last_col")))
    return wide.select(*ranges.columns, "_c", F.inline(blocks)).drop(*TARGET[1:])


def _blocks_of(places: DataFrame, levels: list[int]) -> DataFrame:
    """The blocks of these levels that `places` are in, in the columns of `_pieces`."""
    block = lambda n: F.lit(0).cast("long") if n < 0 else F.shiftright(F.col("row").cast("long"), n)
    held = F.array(*[F.struct(F.lit(n).alias("_level"), block(n).alias("_block")) for n in levels])
    return places.select(F.col("sheet").alias("to_sheet"), F.col("col").alias("_c"), F.inline(held))


@contextmanager
def _kept_in_place(spark: SparkSession):
    """Checkpoints made within it keep how rows are dealt and sorted, so that joins by the same key move the other side only.

    Adaptive execution forgets that, so it is off meanwhile.
    """
    name = "spark.sql.adaptive.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def dependents(cells: DataFrame, changed: DataFrame) -> DataFrame:
    """(sheet, row, col, steps): every formula that a change of the places `changed` reaches, and after how many steps.

    Each round joins the blocks of the places reached last with those of the distinct targets, and the targets that
    hold one with the formulas that name them; targets seen before are left out, so cycles end, after as many rounds as
    the longest chain of formulas. Targets and formulas are dealt and sorted once, a target that very many formulas
    name in parts; a round deals out what it reached. Joins are merges throughout: Spark's estimates know nothing of
    what formulas explode to, so a table that it took for small would fill the driver as a broadcast.
    A formula that is itself changed is listed only if a change reaches it.
    """
    rows = [F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in TARGET[1:3]]  # whole columns, in a form that equals itself
    links = cut(references(cells).select(*PLACE, "to_sheet", *rows, *TARGET[3:]).distinct())
    targets = cut(links.groupBy(*TARGET).agg(F.ceil(F.count(F.lit(1)) / PART).alias("_parts")).withColumn("id", F.monotonically_increasing_id()))
    by_block, by_id = (max(2, -(-df.count() // PART)) for df in (targets, links))  # of a single one Spark forgets how it is dealt
    seen, steps, at = [], 0, ["to_sheet", "_c", "_level", "_block"]
    with _kept_in_place(cells.sparkSession):
        part = F.pmod(F.xxhash64(*PLACE), F.col("_parts")).alias("_part")
        named = cut(links.join(targets.hint("merge"), TARGET).select("id", part, *PLACE).repartition(by_id, "id", "_part").sortWithinPartitions("id", "_part"))
        pieces = cut(_pieces(targets).repartition(by_block, *at).sortWithinPartitions(*at))
        levels = sorted(r["_level"] for r in pieces.select("_level").distinct().collect())  # 62 at most
        to_parts = lambda df: df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts").hint("merge")
        front = changed.select(*PLACE)
        while levels:
            blocks = _blocks_of(front, levels).repartition(by_block, *at).distinct()
            hit = pieces.join(blocks.hint("merge"), at, "left_semi").select("id", "_parts")
            for before, _ in seen:
                hit = hit.join(before.select("id").hint("merge"), "id", "left_anti")  # deals `hit` out as `before` is
            steps += 1
            hit = cut((hit if seen else hit.repartition(by_id, "id")).distinct().withColumn("steps", F.lit(steps)))
            found = hit.count()
            if not found:
                break
            seen.append((hit, found))
            while len(seen) > 1 and seen[-2][1] <= 2 * seen[-1][1]:  # so there are few tables, and a row is seldom written again
                (one, n), (other, m) = seen.pop(), seen.pop()
                seen.append((cut(other.union(one).repartition(by_id, "id").sortWithinPartitions("id")), n + m))
            front = named.join(to_parts(hit.select("id", "_parts")), ["id", "_part"], "left_semi").select(*PLACE)
    if not seen:
        return changed.select(*PLACE, F.lit(0).alias("steps")).where("false")
    reached = to_parts(reduce(DataFrame.union, [df for df, _ in seen]))
    return named.join(reached, ["id", "_part"]).groupBy(*PLACE).agg(F.min("steps").alias("steps"))


def without_sheets(cells: DataFrame, removed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells that are left, references that the removal breaks)."""
    return cells.where(~F.col("sheet").isin(removed)), dangling(cells, removed).where("reason = 'removed sheet'")
