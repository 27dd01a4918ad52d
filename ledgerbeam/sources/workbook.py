"""Spreadsheet files as tables of cells (sheet, row, col, value)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CELLS = "path string, sheet string, row int, col int, value string, formula string"


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def cells_of(data: bytes, most_columns: int | None = None) -> Iterator[tuple[str, int, int, str | None, str | None]]:
    """(sheet, row, col, value, formula) of one workbook's bytes; values are the ones stored with formulas."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_LINK)].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for _, e in ET.iterparse(f):
                    if e.tag != f"{_MAIN}c":
                        if e.tag == f"{_MAIN}row":
                            e.clear()
                        continue
                    m = re.fullmatch(r"([A-Z]+)([0-9]+)", e.get("r", ""))
                    if not m or most_columns and column_number(m[1]) > most_columns:
                        continue
                    v, formula = e.find(f"{_MAIN}v"), e.find(f"{_MAIN}f")
                    value = v.text if v is not None else None
                    if e.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif e.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))
                    yield sheet.get("name"), int(m[2]), column_number(m[1]), value, formula.text if formula is not None else None


def read_workbooks(spark: SparkSession, path: str, most_columns: int | None = None) -> DataFrame:
    """Cells of all workbooks under `path`, a file or a glob that Spark can read; a file is one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                rows = [(name, *c) for c in cells_of(data, most_columns)]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value", "formula"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, CELLS)


def grid(cells: DataFrame, columns: dict[int, str]) -> DataFrame:
    """One row for each sheet row, with the chosen columns by number: (sheet, row, names...)."""
    picked = cells.where(F.col("col").isin(*columns))
    return picked.groupBy("sheet", "row").agg(*[F.max(F.when(F.col("col") == n, F.col("value"))).alias(name) for n, name in columns.items()])


def cell(cells: DataFrame, places: dict[str, tuple[int, int]]) -> DataFrame:
    """One row for each sheet with the values at fixed places; null where a cell is absent."""
    return cells.groupBy("sheet").agg(
        *[F.max(F.when((F.col("row") == r) & (F.col("col") == c), F.col("value"))).alias(name) for name, (r, c) in places.items()]
    )
