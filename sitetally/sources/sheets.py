"""Positional operations on raw sheet rows.

Raw rows are ``path, sheet, row_index, cells array<string>`` (and ``sheet_no``,
the sheet's number in its workbook) with a 0-based ``row_index`` per (path,
sheet), written at ingest.  Every positional operation needs one fact per sheet:
its header cells, first or last row.  These sheet indexes are aggregated from the
rows (partially, before a shuffle of one row per sheet and task) and collected
when they have at most ``MAX_INDEX_ROWS`` rows and ``MAX_INDEX_BYTES`` bytes; the
index is then broadcast and the raw rows are neither shuffled nor sorted, however
many a sheet holds.  A larger index is joined instead.
Rows that come with the index written at ingest (``SheetRows``) need none of that:
``sheet_table`` reads them once, with no job while the plan is built.
Columns are read by position, ``cells[n]``: repeated or blank headers are harmless
(the first of equal headers counts).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE_KEYS = ("path", "sheet")
TOP_ROWS = 32


class SheetRows(NamedTuple):
    """Raw rows and the index of their sheets: number, last row and the first ``TOP_ROWS``
    rows of each (``schemas.SHEET_INDEX``).

    The first row at or after row ``skip`` is among the first ``skip`` + 1, as no more
    than ``skip`` rows come before it: the index holds every header for ``skip`` < ``TOP_ROWS``.
    """

    rows: DataFrame
    index: DataFrame


def skip_rows(rows: DataFrame, k: int) -> DataFrame:
    """Drop the first ``k`` physical rows of every file (``skip = k`` /
    ``df[-1:-k, ]``)."""
    return rows.filter(F.col("row_index") >= F.lit(k))


MAX_INDEX_ROWS = 50_000
MAX_INDEX_BYTES = 32 * 1024 * 1024
MAX_HEADER_PLACES = 100


def _small(index: DataFrame) -> list | None:
    """Rows of a sheet index if it is small enough to send along, else None."""
    size = F.octet_length(F.to_json(F.struct(*index.columns)))
    few = index.withColumn("_size", size).limit(MAX_INDEX_ROWS + 1).collect()
    if len(few) > MAX_INDEX_ROWS or sum(r["_size"] for r in few) > MAX_INDEX_BYTES:
        return None
    return [tuple(r)[:-1] for r in few]


def _with_index(rows: DataFrame, index: DataFrame, few: list | None) -> DataFrame:
    """``rows`` joined to the index of their sheet: by broadcast of its rows ``few``,
    or by a plain join if it was too large to collect."""
    if few is None:
        return rows.join(index, on=list(FILE_KEYS))
    local = rows.sparkSession.createDataFrame(few, index.schema)
    return rows.join(F.broadcast(local), on=list(FILE_KEYS))


def _bounds(rows: DataFrame) -> DataFrame:
    """One row per file: first and last row index (a hash aggregate that reads no cells)."""
    return rows.groupBy(*FILE_KEYS).agg(F.min("row_index").alias("_first"),
                                        F.max("row_index").alias("_last"))


def drop_footer(rows: DataFrame, k: int) -> DataFrame:
    """Drop the last ``k`` rows of every file (``head(-k)``)."""
    last = _bounds(rows).drop("_first")
    return (_with_index(rows, last, _small(last))
            .filter(F.col("row_index") <= F.col("_last") - F.lit(k))
            .drop("_last"))


def _expected_headers(rows: DataFrame, expected: int) -> DataFrame | None:
    """The index of ``_headers`` in one pass, if every file's first row is ``expected``
    (as it is unless that row is blank) and the index is small; else None."""
    found = rows.groupBy(*FILE_KEYS).agg(
        F.min("row_index").alias("_first"), F.max("row_index").alias("_last"),
        F.collect_list(F.when(F.col("row_index") == F.lit(expected), F.col("cells"))).alias("_tops"))
    few = _small(found)
    if few is None or any(r[2] != expected for r in few):
        return None
    local = rows.sparkSession.createDataFrame(few, found.schema)
    return local.select(*FILE_KEYS, "_first", "_last",
                        F.transform(F.get("_tops", F.lit(0)), F.trim).alias("_header"))


def _headers(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """One row per file: first and last index and the trimmed cells of the first row."""
    if expected is not None:
        index = _expected_headers(rows, expected)
        if index is not None:
            return index
    bounds = _bounds(rows)
    few = _small(bounds)
    top = rows
    if few is not None and len(firsts := {r[2] for r in few}) <= MAX_HEADER_PLACES:
        top = rows.filter(F.col("row_index").isin(sorted(firsts)))      # pushed to the scan
    return (_with_index(top, bounds, few).filter("row_index = _first")
            .select(*FILE_KEYS, "_first", "_last", F.transform("cells", F.trim).alias("_header")))


def promote_header(rows: DataFrame) -> DataFrame:
    """Use the first remaining row of each file as its header.

    Returns the rows after it with ``cells`` and the sheet's ``header``; each file
    may order its columns differently.
    """
    index = _headers(rows)
    data = _with_index(rows, index, _small(index)).filter(F.col("row_index") > F.col("_first"))
    return data.select(*FILE_KEYS, "row_index", F.col("_header").alias("header"), "cells")


def _cell(header: str, name: str):
    """The cell under the first header ``name``; NULL where a file has none."""
    return F.get("cells", F.nullif(F.array_position(header, F.lit(name)), F.lit(0)).cast("int") - 1)


def project_fields(rows: DataFrame, columns: Mapping[str, str] | Sequence[str],
                   keep: Sequence[str] = FILE_KEYS + ("row_index",)) -> DataFrame:
    """Select header fields as columns: ``{out_name: header}`` or header names
    (renamed to snake_case).  A header missing in a file gives NULL."""
    from sitetally.sources.tables import snake
    if not isinstance(columns, Mapping):
        columns = {snake(h): h for h in columns}
    return rows.select(*keep, *[_cell("header", h).alias(out) for out, h in columns.items()])


def _of_sheet(df: DataFrame, sheet: str | int | None) -> DataFrame:
    if sheet is None:
        return df
    return df.filter(F.col("sheet_no" if isinstance(sheet, int) else "sheet") == F.lit(sheet))


def _indexed_headers(index: DataFrame, skip: int) -> DataFrame:
    """The index of ``_headers`` from the one written at ingest."""
    top = F.get(F.filter("tops", lambda r: r["row_index"] >= F.lit(skip)), F.lit(0))
    return (index.select(*FILE_KEYS, F.col("last").alias("_last"), top.alias("_top"))
            .filter("_top is not null")
            .select(*FILE_KEYS, F.col("_top.row_index").alias("_first"), "_last",
                    F.transform("_top.cells", F.trim).alias("_header")))


def sheet_table(rows: DataFrame | SheetRows, columns: Mapping[str, str] | Sequence[str], skip: int = 0,
                footer: int = 0, sheet: str | int | None = None) -> DataFrame:
    """Raw rows -> a table: keep one sheet (by name, by number in workbook order, or
    all), skip ``skip`` rows, use the next row as header, drop ``footer`` trailing
    rows, select ``columns``.

    Column positions, header row and last row come from one index row per sheet
    (same result as ``skip_rows`` -> ``promote_header`` -> ``drop_footer``: one pass for
    the index, and one for the table).  With ``SheetRows`` the index is the one written at
    ingest: the rows are read once, and Spark chooses the join by the index's size.
    """
    from sitetally.sources.tables import snake
    if not isinstance(columns, Mapping):
        columns = {snake(h): h for h in columns}
    known = None
    if isinstance(rows, SheetRows):
        rows, known = rows
        known = _of_sheet(known, sheet) if skip < TOP_ROWS else None
    rows = _of_sheet(rows, sheet)
    if skip:
        rows = skip_rows(rows, skip)
    places = [F.nullif(F.array_position("_header", F.lit(h)), F.lit(0)).cast("int").alias(f"_at_{out}")
              for out, h in columns.items()]
    if known is not None:
        index = _indexed_headers(known, skip).select(*FILE_KEYS, "_first", "_last", *places)
        joined = rows.join(index, on=list(FILE_KEYS))
    else:
        index = _headers(rows, skip).select(*FILE_KEYS, "_first", "_last", *places)
        joined = _with_index(rows, index, _small(index))
    return (joined
            .filter((F.col("row_index") > F.col("_first"))
                    & (F.col("row_index") <= F.col("_last") - F.lit(footer)))
            .select(*FILE_KEYS, "row_index",
                    *[F.get("cells", F.col(f"_at_{out}") - 1).alias(out) for out in columns]))
