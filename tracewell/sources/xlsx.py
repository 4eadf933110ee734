"""Spreadsheets by zip and XML alone: sheets, rows with their original numbers, and mapped material rows."""

from __future__ import annotations

import io
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = "source_path string, sheet string, sheet_no int, row_index int, cells array<string>"
_DATES = {*range(14, 23), *range(45, 48)}


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def read_workbook(content: bytes) -> list[tuple[str, int, int, list]]:
    """(sheet, sheet number, row number from 1, cells); blank rows left out, blank cells at the end cut."""
    book = zipfile.ZipFile(io.BytesIO(content))
    xml = lambda name: ElementTree.fromstring(book.read(name))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in xml("xl/sharedStrings.xml").iter(f"{_M}si")]
    dated: list[bool] = []
    if "xl/styles.xml" in book.namelist():
        styles = xml("xl/styles.xml")
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{_M}numFmt") if any(c in f.get("formatCode", "").lower() for c in "ymd")}
        xfs = styles.find(f"{_M}cellXfs")
        dated = [int(x.get("numFmtId", 0)) in _DATES | own for x in (xfs if xfs is not None else [])]
    targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
    out = []
    for n, sheet in enumerate(xml("xl/workbook.xml").iter(f"{_M}sheet")):
        target = targets[sheet.get(f"{_R}id")].lstrip("/")
        for row in xml(target if target.startswith("xl/") else f"xl/{target}").iter(f"{_M}row"):
            cells: list = []
            for c in row.iter(f"{_M}c"):
                kind, v = c.get("t"), c.find(f"{_M}v")
                value = None if v is None else v.text
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                elif kind == "b" and value is not None:
                    value = "true" if value == "1" else "false"
                elif kind is None and value is not None and (s := int(c.get("s", 0))) < len(dated) and dated[s]:
                    value = (datetime(1899, 12, 30) + timedelta(days=float(value))).strftime("%Y-%m-%d")
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (at - len(cells)) + [value]
            while cells and (cells[-1] is None or not cells[-1].strip()):
                cells.pop()
            if cells:
                out.append((sheet.get("name"), n, int(row.get("r")), cells))
    return out


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every row of every sheet of the workbooks under ``path``; one workbook is read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, *r) for p, c in zip(pdf.path, pdf.content) for r in read_workbook(c)]
            yield pd.DataFrame(rows, columns=["source_path", "sheet", "sheet_no", "row_index", "cells"])

    return files.mapInPandas(run, SCHEMA)


def read_sheet(rows: DataFrame, sheet: str | None = None, max_rows: int = 50) -> DataFrame:
    """The first ``max_rows`` rows of a sheet (the first one by default) of each workbook, with total_rows."""
    rows = rows.where(F.col("sheet") == sheet) if sheet is not None else rows.where("sheet_no = 0")
    w = Window.partitionBy("source_path", "sheet")
    rows = rows.withColumn("total_rows", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("row_index")))
    return rows.where(F.col("_n") <= max_rows).drop("_n")


def map_material_rows(rows: DataFrame, columns: dict[str, str], header_row: int = 1) -> DataFrame:
    """source_path, sheet, row_index, one column a field, error: rows by the names in the header row.

    columns: field to header text. Headers compare trimmed and in lower case; a header that is missing or
    given twice is an error of every row of its sheet, a price that is no number an error of its row.
    """
    tidy = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    heads = rows.where(F.col("row_index") == header_row).select("source_path", "sheet", F.transform("cells", lambda c: tidy(F.coalesce(c, F.lit("")))).alias("_h"))
    body = rows.where(F.col("row_index") > header_row).join(heads, ["source_path", "sheet"], "left")
    out, errors = ["source_path", "sheet", "row_index"], []
    for field, header in columns.items():
        name = header.strip().lower()
        at = F.array_position("_h", F.lit(name))
        count = F.size(F.filter("_h", lambda h: h == name))
        value = F.nullif(F.trim(F.try_element_at("cells", F.when(at > 0, at).cast("int"))), F.lit(""))
        errors += [F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(f"missing column {header}")), F.when(count > 1, F.lit(f"duplicate column {header}"))]
        if field == "unit_price":
            number = F.regexp_replace(value, ",", "")
            price = F.when(number.rlike(r"^-?\d+(\.\d+)?$"), number.try_cast("double"))
            errors.append(F.when(value.isNotNull() & price.isNull(), F.lit("price is no number")))
            value = price
        body = body.withColumn(f"_f_{field}", value)
        out.append(F.col(f"_f_{field}").alias(field))
    return body.select(*out, F.coalesce(*errors).alias("error"))
