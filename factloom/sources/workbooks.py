"""XLSX lists, read from the files' bytes with the standard library: any store that Spark reads will do."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed names of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CELLS = "path string, sheet string, row long, cells array<string>"


def column_number(reference: str) -> int:
    """Place of a cell from its reference: A1 is 0, AB7 is 27."""
    place = 0
    for letter in re.match("[A-Z]*", reference.upper())[0]:
        place = place * 26 + ord(letter) - 64
    return place - 1


def _text(element) -> str:
    """The text of an element's runs; readings set above characters are no part of it."""
    if element is None:
        return ""
    parts = [element] if element.find(f"{_MAIN}r") is None else element.findall(f"{_MAIN}r")
    return "".join(t.text or "" for p in parts for t in p.findall(f"{_MAIN}t"))


def _targets(book: zipfile.ZipFile) -> dict[str, str]:
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    return {x.get("Id"): x.get("Target") for x in links}


def sheets(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet, row number from 1 and cells of a workbook's rows, as text; rows and cells without content are left out and null. Dates
    are the numbers that the file holds."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, item in ElementTree.iterparse(f):
                    if item.tag == f"{_MAIN}si":
                        shared.append(_text(item))
                        item.clear()
        targets = _targets(book)
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_LINK)]
            number = 0
            with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    number = int(row.get("r") or number + 1)
                    cells: list[str | None] = []
                    for cell in row.findall(f"{_MAIN}c"):
                        at = column_number(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        value, kind = cell.findtext(f"{_MAIN}v"), cell.get("t")
                        if kind == "s" and value is not None:
                            value = shared[int(value)]
                        elif kind == "inlineStr":
                            value = _text(cell.find(f"{_MAIN}is"))
                        elif kind == "b" and value is not None:
                            value = "true" if value == "1" else "false"
                        cells[at] = value
                    if any(c is not None for c in cells):
                        yield sheet.get("name"), number, cells
                    row.clear()


def _reading(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame.path, frame.content, strict=True):
            rows = []
            for sheet, number, cells in sheets(bytes(content)):
                rows.append((path, sheet, number, cells))
                if len(rows) == 5000:
                    yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row and cells of all rows of the workbooks at a path, a task for each file or several."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(_reading, _CELLS)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A list with a header, all columns strings: the rows of one sheet, the first of the workbook by default, under the names in its
    first row. Columns without a name are left out, and of equal names the later ones get a number."""
    rows = read_cells(spark, path)
    named = rows if sheet is None else rows.where(F.col("sheet") == sheet)
    first = named.select("path", "sheet", "row", "cells").limit(1).collect()
    if not first:
        raise ValueError(f"no rows in {path}" + (f", sheet {sheet}" if sheet else ""))
    head, names, seen = first[0], [], {}
    for at, cell in enumerate(head.cells):
        name = (cell or "").strip()
        if name:
            seen[name] = seen.get(name, 0) + 1
            names.append((at, name if seen[name] == 1 else f"{name} {seen[name]}"))
    body = named.where((F.col("sheet") == head.sheet) & ~((F.col("row") == head.row) & (F.col("path") == head.path)))
    return body.select(*(F.try_element_at("cells", F.lit(at + 1)).alias(name) for at, name in names))
