"""Sheet layouts of the report inputs: raw sheet rows -> typed fact tables.

Each layout names the sheet, how many rows precede the header row, how many
footer rows follow the data, and the header of each used column.  Typing
trims cells, reads blanks as NULL and converts with ``try_cast``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitetally.functions.measures import HOURS_DECIMAL
from sitetally.sources.sheets import SheetRows, sheet_table
from sitetally.sources.tables import blank_to_null, typed_incidents


@dataclass(frozen=True)
class Layout:
    sheet: str | int | None     # a name, a number in workbook order (0: the first), or all
    skip: int
    footer: int
    columns: dict[str, str]


# Sheet names, preamble/footer row counts and column headers of
# the source workbooks.
EXEMPT = Layout("Sheet1", 0, 0, {"l4_org_unit": "L4 Org Unit Name",
                                 "personnel_area": "Personnel Area Desc",
                                 "hours": "Total Hours"})
NONEXEMPT = Layout("Details", 0, 0, {"cost_center": "Cost Center Desc.",
                                     "wage_type": "Wagetype Desc.",
                                     "hours": "Hours"})
INCIDENTS = Layout("Data", 3, 0, {"location": "Location",
                                  "loss_date_raw": "Loss Date",
                                  "lost_days_raw": "Lost Work Days"})
EXPENDITURES = Layout(0, 1, 3, {"cost_center": "Cost Center",
                                   "hours": "View Billable Hours [ST/Hr]"})


def read_layout(rows: DataFrame | SheetRows, layout: Layout) -> DataFrame:
    t = sheet_table(rows, layout.columns, layout.skip, layout.footer, layout.sheet)
    return blank_to_null(t, list(layout.columns))


def _hours(df: DataFrame) -> DataFrame:
    return df.withColumn("hours", F.col("hours").try_cast(HOURS_DECIMAL))


def exempt_hours(rows: DataFrame | SheetRows) -> DataFrame:
    return _hours(read_layout(rows, EXEMPT))


def nonexempt_hours(rows: DataFrame | SheetRows) -> DataFrame:
    return _hours(read_layout(rows, NONEXEMPT))


def incidents(rows: DataFrame | SheetRows) -> DataFrame:
    return typed_incidents(read_layout(rows, INCIDENTS))


def expenditures(rows: DataFrame | SheetRows) -> DataFrame:
    return _hours(read_layout(rows, EXPENDITURES))
