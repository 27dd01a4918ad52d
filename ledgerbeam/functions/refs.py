"""Cell references in formulas, moved when sheets are stacked into one: Column expressions only.

One replacement by one pattern writes a formula as records: a reference's parts (its sheet, and for each corner of the
range what stands before the row, and the row) and what comes before it. A record is shifted and written out again;
everything else is handed on as it stands. Lambdas are interpreted, so they do as little as possible.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHEET = r"(?:(?:'(?:[^']++|'')++'|[\p{L}_][\w.]*+)!)"
_CORNER = r"\$?[A-Z]{1,3}\$?[0-9]+"
_COLUMN = r"\$?[A-Z]{1,3}"
#: What follows shows names of functions and sheets that look like a reference (LOG10).
_REFERENCE = rf"{_SHEET}?(?:{_CORNER}(?::{_CORNER})?|{_COLUMN}:{_COLUMN})(?![\w(.!])"
_TEXT = r"""(?:"(?:[^"]++|"")*+"|"[^"]*+")"""
_NAME = r"(?:'(?:[^']++|'')*+'|'[^']*+'|[\w.$]++)"
#: All up to a reference: signs, quoted text, quoted and other names, numbers. Loops are possessive, so they take no stack.
_REST = rf"""(?:[^\w.$'"]++|{_TEXT}|(?!{_REFERENCE})(?:{_NAME}|.))*+"""
_PARTS = r"(\$?[A-Z]{1,3}\$?)([0-9]+)"
#: Groups: the rest before, the reference, its sheet, head and row of both corners, both columns.
_PIECE = rf"(?sU)({_REST})(?:(({_SHEET})?(?:{_PARTS}(?::{_PARTS})?|({_COLUMN}):({_COLUMN}))(?![\w(.!]))|\z)"
#: Between records and between their fields; formulas that contain one are cut group by group.
_RECORD, _FIELD = "\x01", "\x02"


@dataclass(frozen=True)
class Move:
    """Where a sheet's rows go: the sheet, the offset of its rows, and its first and last row there."""

    sheet: str
    offset: int
    first: int
    last: int


def _table(entries: dict[str, Column], kind: str) -> Column:
    """A map from sheet names, as a literal: workbooks have few sheets."""
    if not entries:
        return F.expr(f"cast(map() as map<string,{kind}>)")
    return F.create_map(*[x for name, value in entries.items() for x in (F.lit(name), value)])


def _prefixes(name: str) -> list[str]:
    """How a formula may write a sheet before a reference."""
    quoted = "'" + name.replace("'", "''") + "'!"
    return [quoted] if "'" in name else [quoted, name + "!"]


def moves_table(moves: dict[str, Move], by_prefix: bool = False) -> Column:
    """Moves by the name of the sheet, or by each way to write it before a reference."""
    return _table(
        {
            key: F.struct(F.lit(m.sheet).alias("sheet"), F.concat(sheet_name(F.lit(m.sheet)), F.lit("!")).alias("written"), F.lit(m.offset).alias("offset"), F.lit(m.first).alias("first"), F.lit(m.last).alias("last"))
            for name, m in moves.items()
            for key in (_prefixes(name) if by_prefix else [name])
        },
        "struct<sheet:string,written:string,offset:int,first:int,last:int>",
    )


def sheet_name(sheet: Column) -> Column:
    """A sheet's name as a formula has to write it: in quotes, with inner ones doubled, unless it is plain."""
    return F.when(sheet.rlike("^[A-Za-z0-9_]+$"), sheet).otherwise(F.concat(F.lit("'"), F.replace(sheet, F.lit("'"), F.lit("''")), F.lit("'")))


def _records(formula: Column) -> Column:
    """A formula's pieces in order: what comes before a reference, the reference, its sheet with "!", head and row of both corners.

    Empty where there is none; the last piece is no reference.
    """
    body = F.substr(formula, F.lit(2))
    fields = _FIELD.join(["$1", "$2", "$3", "$4$8", "$5", "$6$9", "$7"])
    marked = F.regexp_replace(body, F.lit(_PIECE), F.lit(_RECORD + fields))
    split = F.transform(F.split(F.substr(marked, F.lit(2)), _RECORD), lambda r: F.split(r, _FIELD))
    groups = F.arrays_zip(*[F.regexp_extract_all(body, F.lit(_PIECE), i).alias(f"g{i}") for i in range(1, 10)])
    apart = F.transform(groups, lambda g: F.array(g["g1"], g["g2"], g["g3"], F.concat(g["g4"], g["g8"]), g["g5"], F.concat(g["g6"], g["g9"]), g["g7"]))
    return F.when(body.contains(_RECORD) | body.contains(_FIELD), apart).otherwise(split)


def _number(digits: Column) -> Column:
    """Null without digits, which are not handed to the cast: that makes an exception of each."""
    return F.when(digits != "", digits.try_cast("bigint"))


def _moved(p: Column, to: Column, home: Column, renamed: Column) -> Column:
    """The reference of a record, whose sheet moves to `to`; `home` is the sheet that its formula ends up on.

    Rows shift, absolute ones too. Whole columns end at the rows of the moved sheet. The sheet is written only
    where it isn't the formula's own. A sheet that stays keeps its references, under its new name if it has one.
    """

    def corner(head, row, edge):
        shifted = F.concat(head, (_number(row) + to["offset"]).cast("string"))
        return F.coalesce(shifted, F.concat(F.rtrim(head, F.lit("$")), F.lit("$"), to[edge].cast("string")))

    sheet = F.when(to["sheet"] == home, "").otherwise(to["written"])
    second = F.when(p[5] == "", "").otherwise(F.concat(F.lit(":"), corner(p[5], p[6], "last")))
    new = F.concat(F.try_element_at(renamed, p[2]), F.substr(p[1], F.length(p[2]) + 1))
    return F.when(to.isNotNull(), F.concat(sheet, corner(p[3], p[4], "first"), second)).otherwise(F.coalesce(new, p[1]))


def references_of(formula: Column, here: Column) -> Column:
    """The references of a formula of sheet `here`, in order, as (token, fields of (sheet, corners of (col, row)))."""
    bare = lambda s: F.left(s, F.length(s) - 1)
    quoted = lambda s: F.replace(F.substring(s, F.lit(2), F.length(s) - 3), F.lit("''"), F.lit("'"))
    corner = lambda head, row: F.struct(head.alias("col"), _number(row).alias("row"))
    sheet = lambda s: F.when(s == "", here).when(s.startswith("'"), quoted(s)).otherwise(bare(s))
    corners = lambda p: F.when(p[5] == "", F.array(corner(p[3], p[4]))).otherwise(F.array(corner(p[3], p[4]), corner(p[5], p[6])))
    found = F.filter(_records(formula), lambda p: p[1] != "")
    return F.transform(found, lambda p: F.struct(p[1].alias("token"), F.struct(sheet(p[2]).alias("sheet"), corners(p).alias("corners")).alias("fields")))


def translate(formula: Column, here: Column, moves: dict[str, Move], renamed: dict[str, str] | None = None) -> Column:
    """A formula of sheet `here` with its references moved; what is no formula, null too, comes back as it is."""
    own, table = F.try_element_at(moves_table(moves), here), moves_table(moves, by_prefix=True)
    names = _table({key: F.concat(sheet_name(F.lit(v)), F.lit("!")) for k, v in (renamed or {}).items() for key in _prefixes(k)}, "string")
    home = F.coalesce(own["sheet"], here)
    # `to` has its own step: an expression is worked out again for every use in a lambda
    placed = F.transform(_records(formula), lambda p: F.struct(p.alias("p"), F.when(p[2] == "", own).otherwise(F.try_element_at(table, p[2])).alias("to")))
    rewritten = F.transform(placed, lambda x: F.when(x["p"][1] == "", x["p"][0]).otherwise(F.concat(x["p"][0], _moved(x["p"], x["to"], home, names))))
    return F.when(formula.startswith("="), F.concat(F.lit("="), F.array_join(rewritten, ""))).otherwise(formula)


def translate_cells(cells: DataFrame, moves: dict[str, Move], renamed: dict[str, str] | None = None) -> DataFrame:
    """Move a table of cells (sheet, row, col, value): formulas, places and provenance, one row at a time in the JVM.

    Cells of moved sheets land on their new sheet; src_sheet and src_row say where they were. is_calculated
    marks moved formulas.
    """
    to = F.try_element_at(moves_table(moves), F.col("sheet"))
    formula = F.coalesce(F.col("value").startswith("="), F.lit(False))
    # src_sheet and src_row first: inside a lambda, `sheet` could also be taken for the new column of that name
    named = cells.select("col", "value", F.col("sheet").alias("src_sheet"), F.col("row").alias("src_row"), to.alias("to"), formula.alias("formula"))
    return named.select(
        F.coalesce("to.sheet", "src_sheet").alias("sheet"),
        (F.col("src_row") + F.coalesce("to.offset", F.lit(0))).cast("int").alias("row"),
        "col",
        translate(F.col("value"), F.col("src_sheet"), moves, renamed).alias("value"),
        "src_sheet",
        "src_row",
        (F.col("to").isNotNull() & F.col("formula")).alias("is_calculated"),
    )
