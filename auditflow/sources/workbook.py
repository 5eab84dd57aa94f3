"""Excel workbooks: many files in, one row per sheet row out.

Spark hands each workbook to a task; a workbook is admitted only up to a size
that fits one (see ``manifest.admission``). The package format is a zip of XML
parts, read here as a stream with the standard library.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditflow.session import ship_package
from auditflow.sources.manifest import MAX_FILE_BYTES

ROWS_SCHEMA = "path string, sheet_no int, sheet string, row_no long, cells map<string,string>"
ROWS_PER_BATCH = 2000

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BUILT_IN_DATE_FORMATS = range(14, 23)
EPOCH = datetime(1899, 12, 30)


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _part(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else ElementTree.Element("none")


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Sheet names in workbook order with the part that holds each."""
    targets = {r.get("Id"): r.get("Target") for r in _part(book, "xl/_rels/workbook.xml.rels")}
    found = []
    for sheet in _part(book, "xl/workbook.xml").iter(f"{MAIN}sheet"):
        target = targets[sheet.get(RELATION)].lstrip("/")
        found.append((sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return found


def _date_styles(book: zipfile.ZipFile) -> set[str]:
    styles = _part(book, "xl/styles.xml")
    custom = {f.get("numFmtId") for f in styles.iter(f"{MAIN}numFmt") if "yy" in f.get("formatCode", "").lower()}
    formats = styles.find(f"{MAIN}cellXfs")
    used = [x.get("numFmtId", "0") for x in formats] if formats is not None else []
    return {str(i) for i, f in enumerate(used) if f in custom or int(f) in BUILT_IN_DATE_FORMATS}


def _cell(node, shared: list[str], date_styles: set[str]) -> str:
    kind = node.get("t")
    if kind == "inlineStr":
        return _text(node)
    value = node.findtext(f"{MAIN}v") or ""
    if kind == "s":
        return shared[int(value)]
    if value and kind in (None, "n") and node.get("s") in date_styles:
        return str(EPOCH + timedelta(days=float(value)))
    return value


def _sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str], date_styles: set[str]) -> Iterator[tuple[int, dict]]:
    with book.open(part) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != f"{MAIN}row":
                continue
            cells = {re.sub(r"\d", "", c.get("r")): _cell(c, shared, date_styles) for c in row.iter(f"{MAIN}c")}
            yield int(row.get("r")), cells
            row.clear()


def _workbook_rows(path: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_text(item) for item in _part(book, "xl/sharedStrings.xml").iter(f"{MAIN}si")]
        date_styles = _date_styles(book)
        for number, (name, part) in enumerate(_sheets(book)):
            for row_no, cells in _sheet_rows(book, part, shared, date_styles):
                yield path, number, name, row_no, cells


def _in_batches(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "sheet_no", "sheet", "row_no", "cells"]
    for batch in files:
        for path, content in zip(batch["path"], batch["content"]):
            rows = []
            for row in _workbook_rows(path, content):
                rows.append(row)
                if len(rows) == ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def workbook_rows(spark: SparkSession, path: str, *, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Rows of all sheets of all workbooks under ``path``; cells are text by column letter.

    A workbook larger than ``max_bytes`` fails the read; ``manifest.admission`` names those beforehand.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    too_large = F.col("length") > max_bytes
    if not files.where(too_large).limit(1).isEmpty():
        names = [r.path for r in files.where(too_large).select("path").limit(5).collect()]
        raise ValueError(f"workbooks exceed {max_bytes} bytes: {names}")
    return files.select("path", "content").mapInPandas(_in_batches, ROWS_SCHEMA)


def sheet_names(rows: DataFrame) -> DataFrame:
    """Sheets per workbook in workbook order. Sheets without rows do not show."""
    sheets = rows.select("path", "sheet_no", "sheet").distinct()
    listed = F.transform(F.sort_array(F.collect_list(F.struct("sheet_no", "sheet"))), lambda s: s["sheet"])
    return sheets.groupBy("path").agg(listed.alias("sheets"))


def sheet_table(rows: DataFrame, *, sheet: str | None = None, header_row: int = 1) -> DataFrame:
    """One sheet (the first by default) as a text table. Reads one header row to name the columns.

    For several workbooks of one layout: the header of the first by path names the
    columns, and a workbook whose header differs is an error.
    """
    wanted = rows.where(F.col("sheet_no") == 0) if sheet is None else rows.where(F.col("sheet") == sheet)
    header = wanted.where(F.col("row_no") == header_row).orderBy("path").select("cells").first()
    if header is None:
        raise ValueError(f"no header row in sheet {sheet or '(first)'}")
    letters = sorted(header.cells, key=lambda letter: (len(letter), letter))
    expected = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(header.cells[k]).alias("value")) for k in sorted(letters)])
    headers = wanted.where(F.col("row_no") == header_row)
    differs = ~F.array_sort(F.map_entries("cells")).cast("array<struct<key:string,value:string>>").eqNullSafe(expected)
    other = headers.where(differs).select("path").first()
    if other is not None:
        raise ValueError(f"the header of {other.path} differs from that of the first workbook")
    return wanted.where(F.col("row_no") > header_row).select(
        *[F.coalesce(F.col("cells")[letter], F.lit("")).alias(header.cells[letter]) for letter in letters]
    )
