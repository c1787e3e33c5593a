"""Typed table input.

Source sheets have header names with spaces, dots and brackets and cells
that are text.  Ingest renames to snake_case, trims cell whitespace, turns
blank cells into NULL and converts declared types with ``try_cast`` so a bad
cell becomes NULL (and is counted) instead of failing the job.  Key text is
never normalised beyond trimming.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitetally.functions.dates import serial_to_date

# Source header -> column name, as the source sheets spell them.
SOURCE_COLUMNS = {
    "L4 Org Unit Name": "l4_org_unit",
    "Personnel Area Desc": "personnel_area",
    "Total Hours": "hours",
    "Cost Center Desc.": "cost_center",
    "Wagetype Desc.": "wage_type",
    "Hours": "hours",
    "Location": "location",
    "Loss Date": "loss_date_raw",
    "Lost Work Days": "lost_days_raw",
    "Cost Center": "cost_center",
    "View Billable Hours [ST/Hr]": "hours",
    "Facility": "facility",
    "Section": "section",
}


def snake(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def normalise_names(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Rename source headers (``names`` first, then snake_case)."""
    names = dict(SOURCE_COLUMNS if names is None else names)
    return df.withColumnsRenamed({c: names.get(c, snake(c)) for c in df.columns})


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", names: Mapping[str, str] | None = None,
               **options) -> DataFrame:
    """Read a table with a declared schema (no inference) and normalise names."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return normalise_names(reader.load(path), names)


def blank_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Trim string cells and turn empty ones into NULL (spreadsheet reader rule)."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cols = strings if cols is None else [c for c in cols if c in strings]
    return df.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in cols})


def _cast(c: Column, kind: str) -> Column:
    if kind == "serial_date":
        return serial_to_date(c)
    return c.try_cast(kind)


def typed_incidents(raw: DataFrame, location: str = "location",
                    loss_date: str = "loss_date_raw",
                    lost_days: str = "lost_days_raw") -> DataFrame:
    """Incident text columns -> ``location string, loss_date date, lost_days double``."""
    clean = blank_to_null(raw, [location, loss_date, lost_days])
    return clean.select(
        F.col(location).alias("location"),
        _cast(F.col(loss_date), "serial_date").alias("loss_date"),
        _cast(F.col(lost_days), "double").alias("lost_days"),
        *[c for c in raw.columns if c not in (location, loss_date, lost_days)])


def rejected_cells(raw: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """One row: per column, the number of non-blank cells that fail the cast.

    ``kinds`` maps column -> ``double`` / ``int`` / ``serial_date`` / any SQL
    type.  A global aggregate, so it returns one row even for empty input.
    """
    aggs = []
    for col, kind in kinds.items():
        text = F.nullif(F.trim(F.col(col).cast("string")), F.lit(""))
        bad = text.isNotNull() & _cast(text, kind).isNull()
        aggs.append(F.count_if(bad).alias(f"{col}_rejected"))
    return raw.agg(*aggs)
