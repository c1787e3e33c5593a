"""Spreadsheet serial dates and calendar periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: origin of spreadsheet serial day numbers (day 0).
SERIAL_ORIGIN = "1899-12-30"

# English month names, January first.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December")


def serial_to_date(col: Column | str) -> Column:
    """Serial day number (text or number) to DATE; the fraction is floored.

    Text that is not a number gives NULL (``as.numeric`` semantics), so a
    malformed cell never fails the job.
    """
    c = F.col(col) if isinstance(col, str) else col
    number = c.try_cast("double")
    days = F.floor(F.when(~F.isnan(number), number)).try_cast("int")
    return F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), days)


def month_name(col: Column | str) -> Column:
    """Full English month name of a date (``months()``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "MMMM")


def month_number(name: str | int) -> int:
    if isinstance(name, int):
        if not 1 <= name <= 12:
            raise ValueError(f"month out of range: {name}")
        return name
    if name.strip().isdigit():
        return month_number(int(name))
    try:
        return MONTH_NAMES.index(name.strip().capitalize()) + 1
    except ValueError:
        raise ValueError(f"unknown month {name!r}") from None


def period_bounds(year: int, month: str | int) -> tuple[dt.date, dt.date]:
    """First day of the month and first day of the next month."""
    m = month_number(month)
    start = dt.date(int(year), m, 1)
    end = dt.date(int(year) + (m == 12), 1 if m == 12 else m + 1, 1)
    return start, end


def in_period(col: Column | str, year: int, month: str | int) -> Column:
    """``year(d) == y & months(d) == m`` written as a half-open range.

    A range over literals of the column's own type is pushed to the Parquet
    scan as a min/max filter; a month-name predicate is not.  Works for
    DATE, TIMESTAMP and TIMESTAMP_NTZ columns (Catalyst folds the literal
    cast).
    """
    c = F.col(col) if isinstance(col, str) else col
    start, end = period_bounds(year, month)
    lo = F.make_date(F.lit(start.year), F.lit(start.month), F.lit(1))
    hi = F.make_date(F.lit(end.year), F.lit(end.month), F.lit(1))
    return (c >= lo) & (c < hi)


def previous_period(today: dt.date | None = None) -> tuple[int, str]:
    """Default reporting period: the month before ``today``, with *its* year.

    Both parts come from one shifted date, so January reports December of the
    previous year.
    """
    today = today or dt.date.today()
    first = today.replace(day=1)
    last_month = first - dt.timedelta(days=1)
    return last_month.year, MONTH_NAMES[last_month.month - 1]


def previous_period_col() -> Column:
    """Column form: first day of the previous month of ``current_date()``."""
    return F.trunc(F.add_months(F.current_date(), -1), "month")
