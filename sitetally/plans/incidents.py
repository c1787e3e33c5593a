"""Incident report (recordable ``or_cases`` / lost-time ``lt_cases`` counts) and
the combined hours + incidents report.

Rules (reference semantics): incidents are kept for one calendar month (or
grouped by period columns); a location without a mapping is kept under a
NULL facility; a section's lost-time count is NULL when it has incidents but
none with lost days > 0; totals are lenient sums; zeros show as NULL.
Lost days are compared as numbers (text that is not a number never counts).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitetally.functions.dates import in_period
from sitetally.functions.measures import HOURS_VALUE, count_measure, hours_to_double, zero_to_null
from sitetally.operators.levels import label_levels, three_level
from sitetally.operators.mapping import (LABELS, DEFAULT_BROADCAST_ROWS, finish_states,
                                         require_columns, section_states)
from sitetally.plans.hours import EXCLUDED_WAGE_TYPES, combined_hour_sections

INCIDENT_KEY = "location"
COUNTS = ("or_cases", "lt_cases")


def incident_measures(lost_col: str = "lost_days"):
    days = F.col(lost_col).try_cast("double")
    lost = ~F.isnan(days) & (days > F.lit(0.0))
    return [count_measure("or_cases"),
            count_measure("lt_cases", lost, absent_as_null=True)]


def period_incidents(incidents: DataFrame, year: int | None = None,
                     month: str | int | None = None,
                     date_col: str = "loss_date") -> DataFrame:
    """Incidents of one month (range filter, pushed to the scan when the
    date is a stored column); all incidents when no period is given."""
    if year is None:
        return incidents
    return incidents.filter(in_period(date_col, year, month))


def incident_sections(incidents: DataFrame, location_map: DataFrame,
                      year: int | None = None, month: str | int | None = None,
                      by: Sequence[str] = (), key: str = INCIDENT_KEY,
                      date_col: str = "loss_date", lost_col: str = "lost_days",
                      broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``or_cases`` and ``lt_cases`` per (by, facility, section), one pass."""
    require_columns(incidents, [*by, key, lost_col] + ([date_col] if year is not None else []),
                    "incidents")
    measures = incident_measures(lost_col)
    inc = period_incidents(incidents, year, month, date_col)
    states = section_states(inc, location_map, [key], measures, by, unmapped="keep",
                            broadcast_rows=broadcast_rows)
    return finish_states(states, measures, by)


def finish_counts(levels: DataFrame, by: Sequence[str] = (), labels: bool = True,
                  lead: Sequence = (), extra: Sequence[str] = ()) -> DataFrame:
    out = levels.select(*by, *LABELS, "row_kind", *extra, *lead,
                        *[zero_to_null(c).cast("long").alias(c) for c in COUNTS])
    return label_levels(out) if labels else out


def incident_report(incidents: DataFrame, location_map: DataFrame,
                    year: int | None = None, month: str | int | None = None,
                    by: Sequence[str] = (), hours_sections: DataFrame | None = None,
                    labels: bool = True, keep_rank: bool = False, **kw) -> DataFrame:
    """Incident counts per section, facility and grand total.

    With ``hours_sections`` (from ``combined_hour_sections``) the rows follow
    the hours report: every hours row is present (with NULL counts when it
    has no incidents), then sections and facilities only seen in incidents.
    """
    sections = incident_sections(incidents, location_map, year, month, by, **kw)
    if hours_sections is None:
        levels = three_level(sections, list(COUNTS), by)
        return finish_counts(levels, by, labels)
    both = _with_hours(sections, hours_sections, by)
    levels = three_level(both, {"hours": "sum", "or_cases": "lenient", "lt_cases": "lenient"},
                         by, rank_col="src_rank")
    extra = ["src_rank"] if keep_rank else []
    return finish_counts(levels, by, labels, extra=extra)


def _with_hours(inc_sections: DataFrame, hours_sections: DataFrame,
                by: Sequence[str]) -> DataFrame:
    """Union of hours sections and incident sections, merged per section."""
    by = list(by)
    hs = hours_sections.select(*by, *LABELS, "hours", "src_rank",
                               *[F.lit(None).cast("long").alias(c) for c in COUNTS])
    ins = inc_sections.select(*by, *LABELS, F.lit(None).cast(HOURS_VALUE).alias("hours"),
                              F.lit(2).alias("src_rank"), *COUNTS)
    return (hs.unionByName(ins).groupBy(*by, *LABELS)
            .agg(F.sum("hours").alias("hours"),
                 *[F.sum(c).alias(c) for c in COUNTS],
                 F.min("src_rank").alias("src_rank")))


def combined_report(exempt: DataFrame, exempt_map: DataFrame, nonexempt: DataFrame,
                    nonexempt_map: DataFrame, incidents: DataFrame, location_map: DataFrame,
                    year: int | None = None, month: str | int | None = None,
                    excluded_wage_types: Sequence[str] = EXCLUDED_WAGE_TYPES,
                    by: Sequence[str] = (), labels: bool = True, keep_rank: bool = False,
                    broadcast_rows: int = DEFAULT_BROADCAST_ROWS, **kw) -> DataFrame:
    """Hours, ``or_cases`` and ``lt_cases`` in one frame on the hours layout.

    Hours are NULL only on rows that exist in the incident data alone.
    """
    hours = combined_hour_sections(exempt, exempt_map, nonexempt, nonexempt_map,
                                   excluded_wage_types, by, broadcast_rows)
    inc = incident_sections(incidents, location_map, year, month, by,
                            broadcast_rows=broadcast_rows, **kw)
    levels = three_level(_with_hours(inc, hours, by),
                         {"hours": "sum", "or_cases": "lenient", "lt_cases": "lenient"},
                         by, rank_col="src_rank")
    extra = ["src_rank"] if keep_rank else []
    return finish_counts(levels, by, labels, extra=extra,
                         lead=[hours_to_double("hours").alias("hours")])
