"""Distributed workbook ingest: a folder of ``.xlsx`` files -> raw sheet rows.

Each workbook is read with the ``binaryFile`` source and decoded inside
``mapInPandas`` (one task decodes one file; a zip archive cannot be split).
Rows are emitted in chunks, so a large sheet never builds one huge batch.
The output ``path, sheet, sheet_no, row_index, cells array<string>`` is the input of
``sitetally.sources.sheets``; write it once as Parquet and every later report
reads typed columns from it.  ``land_workbooks`` writes it together with a sheet
index (last row and first rows of every sheet), which the decoder knows anyway, so
that reports need no pass over the rows to find headers and footers.

Cells are kept as the text the workbook stores (shared or inline strings,
numbers as written, booleans as TRUE/FALSE); typing is done later with
``try_cast``.  ``row_index`` counts from the first non-empty row; blank rows
in between keep their position.
"""

from __future__ import annotations

import datetime as dt
import io
import itertools
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sitetally.schemas import RAW_SHEET as RAW_SCHEMA
from sitetally.schemas import SHEET_INDEX
from sitetally.sources.sheets import TOP_ROWS, SheetRows

CHUNK_ROWS = 10_000
LANDED_SCHEMA = RAW_SCHEMA + ", last bigint, tops array<struct<row_index:bigint,cells:array<string>>>, part string"
_NULLABLE = {"sheet_no": "Int32", "row_index": "Int64", "last": "Int64"}

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_CELL_REF = re.compile(r"([A-Z]+)(\d+)")


def _column_number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(node) -> str:
    """Text of a plain or rich string; phonetic readings (``rPh``) are no text."""
    return "".join(t.text or "" for part in node if part.tag != f"{_MAIN}rPh"
                   for t in part.iter(f"{_MAIN}t"))


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    try:
        data = zf.read("xl/sharedStrings.xml")
    except KeyError:
        return []
    return [_text(si) for si in ET.fromstring(data).iter(f"{_MAIN}si")]


def _sheet_targets(zf: zipfile.ZipFile) -> list[tuple[str, str]]:
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.iter(f"{_PKG_REL}Relationship")}
    out = []
    for s in wb.iter(f"{_MAIN}sheet"):
        t = target[s.get(f"{_REL}id")]
        t = t.lstrip("/")
        out.append((s.get("name"), t if t.startswith("xl/") else f"xl/{t}"))
    return out


def _cell_value(c, shared: list[str]) -> str | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        node = c.find(f"{_MAIN}is")
        return None if node is None else _text(node)
    v = c.find(f"{_MAIN}v")
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "e":                 # an error such as #N/A is a missing value
        return None
    if kind == "d":                 # an ISO date, as the serial day number other cells hold
        try:
            day = dt.datetime.fromisoformat(v.text.strip().replace("Z", ""))
        except ValueError:
            return v.text
        serial = (day - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
        return str(int(serial)) if serial == int(serial) else str(serial)
    if kind == "b":
        return "TRUE" if v.text.strip() == "1" else "FALSE"
    return v.text


def sheet_rows(content: bytes, sheets: Sequence[str] | None = None
               ) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """Yield ``(sheet, sheet_no, row_index, cells)`` for the wanted sheets of one file."""
    zf = zipfile.ZipFile(io.BytesIO(content))
    shared = _shared_strings(zf)
    for number, (name, member) in enumerate(_sheet_targets(zf)):
        if sheets is not None and name not in sheets:
            continue
        first = None
        last = -1
        with zf.open(member) as fh:
            for _, el in ET.iterparse(fh, events=("end",)):
                if el.tag != f"{_MAIN}row":
                    continue
                ref = el.get("r")
                cells: dict[int, str | None] = {}
                for i, c in enumerate(el.iter(f"{_MAIN}c")):
                    m = _CELL_REF.match(c.get("r") or "")
                    col = _column_number(m.group(1)) if m else i
                    cells[col] = _cell_value(c, shared)
                el.clear()
                if not any(v not in (None, "") for v in cells.values()):
                    continue
                phys = int(ref) - 1 if ref else (last + 1 if first is not None else 0)
                last = phys
                if first is None:
                    first = phys
                width = max(cells) + 1
                yield name, number, phys - first, [cells.get(j) for j in range(width)]


def _decode(sheets: Sequence[str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                chunk = []
                for sheet, number, idx, cells in sheet_rows(content, sheets):
                    chunk.append((path, sheet, number, idx, cells))
                    if len(chunk) >= CHUNK_ROWS:
                        yield pd.DataFrame(chunk, columns=["path", "sheet", "sheet_no", "row_index", "cells"])
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=["path", "sheet", "sheet_no", "row_index", "cells"])
    return run


def ingest_workbooks(spark: SparkSession, path: str, sheets: Sequence[str] | None = None,
                     glob: str = "*.xlsx") -> DataFrame:
    """Raw rows of every workbook under ``path`` (lazy; write it once)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    wanted = list(sheets) if sheets is not None else None
    return files.select("path", "content").mapInPandas(_decode(wanted), RAW_SCHEMA)


def _index_rows(path: str, seen: dict) -> pd.DataFrame:
    return pd.DataFrame([(path, sheet, number, last, tops, "index")
                         for sheet, (number, last, tops) in seen.items()],
                        columns=["path", "sheet", "sheet_no", "last", "tops", "part"])


def _land(sheets: Sequence[str] | None):
    names = StructType.fromDDL(LANDED_SCHEMA).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                seen: dict = {}

                def noted():
                    for sheet, number, idx, cells in sheet_rows(content, sheets):
                        number, last, tops = seen.get(sheet, (number, -1, []))
                        if len(tops) < TOP_ROWS:
                            tops.append({"row_index": idx, "cells": cells})
                        seen[sheet] = (number, max(last, idx), tops)
                        yield path, sheet, number, idx, cells

                rows = noted()
                while chunk := list(itertools.islice(rows, CHUNK_ROWS)):
                    part = pd.DataFrame(chunk, columns=["path", "sheet", "sheet_no", "row_index", "cells"])
                    yield part.assign(last=None, tops=None, part="rows").astype(_NULLABLE)[names]
                if seen:
                    yield _index_rows(path, seen).assign(row_index=None, cells=None).astype(_NULLABLE)[names]
    return run


def land_workbooks(spark: SparkSession, path: str, out: str, sheets: Sequence[str] | None = None,
                   glob: str = "*.xlsx") -> SheetRows:
    """Decode every workbook under ``path`` once and write its rows and sheet index below
    ``out`` (one job, committed together); returns both, read back.

    An empty folder gives empty rows and an empty index.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    wanted = list(sheets) if sheets is not None else None
    (files.select("path", "content").mapInPandas(_land(wanted), LANDED_SCHEMA)
          .write.mode("overwrite").partitionBy("part").parquet(out))
    return landed(spark, out)


def landed(spark: SparkSession, out: str) -> SheetRows:
    """Rows and sheet index that ``land_workbooks`` wrote below ``out``."""
    both = spark.read.schema(LANDED_SCHEMA).parquet(out)

    def part(name: str, schema: str) -> DataFrame:
        return both.where(both["part"] == name).select(*StructType.fromDDL(schema).names)

    return SheetRows(part("rows", RAW_SCHEMA), part("index", SHEET_INDEX))
