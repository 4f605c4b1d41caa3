"""Workbooks as rows: sheets of xlsx files, read from the bytes that Spark's binary reader gives.

A file is one task's work, as a zip can't be split; many files spread over tasks. Only cell values
are read: shared and inline strings, numbers, booleans; dates stay the serial numbers they are.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Bytes of one part of a workbook, unpacked: a larger one is taken for a zip bomb.
MOST_BYTES = 1 << 30


def _part(book: zipfile.ZipFile, name: str):
    if book.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} is larger than {MOST_BYTES} bytes")
    return ElementTree.fromstring(book.read(name))


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_MAIN}t"))


def sheet_of(data: bytes, sheet: str | None = None):
    """Yield the rows of a sheet (the active one, or the one of that name) as (row number, cells); empty cells are None. A file of no bytes has none."""
    if not data:
        return
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = [_text(e) for e in _part(book, "xl/sharedStrings.xml").iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        target = {r.get("Id"): r.get("Target") for r in _part(book, "xl/_rels/workbook.xml.rels")}
        workbook = _part(book, "xl/workbook.xml")
        found = [e for e in workbook.iter(f"{_MAIN}sheet") if sheet in (None, e.get("name"))]
        if not found:
            raise ValueError(f"no sheet {sheet}")
        active = next((int(v.get("activeTab") or 0) for v in workbook.iter(f"{_MAIN}workbookView")), 0) if sheet is None else 0
        path = target[found[min(active, len(found) - 1)].get(f"{_REL}id")].lstrip("/")
        for i, row in enumerate(_part(book, path if path.startswith("xl/") else f"xl/{path}").iter(f"{_MAIN}row")):
            cells: list = []
            for k, c in enumerate(row.iter(f"{_MAIN}c")):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [None] * (at + 1 - len(cells))
                value, kind = c.find(f"{_MAIN}v"), c.get("t")
                if kind == "inlineStr":
                    cells[at] = _text(c)
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if kind == "s" else ("FALSE", "TRUE")[int(value.text)] if kind == "b" else value.text
            yield int(row.get("r") or i + 1), cells


def read_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, row, cells array<string>) of a sheet of each xlsx file at path."""

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, n, cells) for p, data in zip(pdf["path"], pdf["content"]) for n, cells in sheet_of(data, sheet)]
            yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, row int, cells array<string>")


def read_table(spark: SparkSession, path: str, sheet: str | None = None, empty=None) -> DataFrame:
    """A sheet whose first row names the columns; all are strings. Files must have the same head; rows without a value are left out.

    empty: names of the columns, without rows, that a sheet without any row is read as; it is an error without them.
    """
    rows = read_rows(spark, path, sheet)
    first = rows.orderBy("path", "row").limit(1).collect()
    if not first:
        if empty is None:
            raise ValueError(f"no rows in {path}")
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in empty))
    names = [(i, n) for i, n in enumerate(first[0]["cells"]) if n]
    body = rows.where((F.col("row") > first[0]["row"]) & F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    return body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in names])
