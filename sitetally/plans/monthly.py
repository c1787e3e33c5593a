"""Everything the monthly tool shows, from one computation of the hours.

The hours table and the incident table both need the section hours of the
two payroll populations.  They are built once and persisted (the frame is
small: one row per section and period), so the fact tables are scanned once
for both tables.  A lost executor only means recomputing its blocks from
lineage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from sitetally.operators.levels import three_level
from sitetally.plans.checks import coding_status, label_alerts, unmapped_report
from sitetally.plans.hours import (EXCLUDED_WAGE_TYPES, EXEMPT_KEYS, combined_hour_sections,
                                   finish_hours)
from sitetally.plans.incidents import (COUNTS, _with_hours, finish_counts, incident_sections)
from sitetally.functions.measures import hours_to_double


@dataclass
class MonthlyReports:
    hours: DataFrame
    incidents: DataFrame
    combined: DataFrame
    unmapped: DataFrame
    status: DataFrame
    alerts: DataFrame
    shared: DataFrame

    def release(self) -> None:
        self.shared.unpersist()
        self.unmapped.unpersist()


def monthly_reports(exempt: DataFrame, exempt_map: DataFrame, nonexempt: DataFrame,
                    nonexempt_map: DataFrame, incidents: DataFrame, location_map: DataFrame,
                    year: int | None = None, month: str | int | None = None,
                    excluded_wage_types: Sequence[str] = EXCLUDED_WAGE_TYPES,
                    alert_rules: DataFrame | None = None, by: Sequence[str] = (),
                    labels: bool = True, keep_rank: bool = False) -> MonthlyReports:
    """``keep_rank`` keeps ``src_rank`` for ``display_view``/``order_report``."""
    by = list(by)
    extra = ["src_rank"] if keep_rank else []
    hours = combined_hour_sections(exempt, exempt_map, nonexempt, nonexempt_map,
                                   excluded_wage_types, by)
    inc = incident_sections(incidents, location_map, year, month, by)
    shared = _with_hours(inc, hours, by).persist(StorageLevel.MEMORY_AND_DISK)

    hours_only = shared.filter(shared.src_rank < 2).select(*by, "facility", "section",
                                                             "hours", "src_rank")
    hours_levels = three_level(hours_only, ["hours"], by, rank_col="src_rank")
    all_levels = three_level(shared, {"hours": "sum", "or_cases": "lenient",
                                      "lt_cases": "lenient"}, by, rank_col="src_rank")
    # read by both the table and the status; few rows, kept like the shared frame
    unmapped = unmapped_report(exempt, exempt_map, EXEMPT_KEYS).persist(StorageLevel.MEMORY_AND_DISK)
    return MonthlyReports(
        hours=finish_hours(hours_levels, by, zero_as_null=False, labels=labels, extra=extra),
        incidents=finish_counts(all_levels, by, labels, extra=extra),
        combined=finish_counts(all_levels, by, labels, extra=extra,
                               lead=[hours_to_double("hours").alias("hours")]),
        unmapped=unmapped,
        status=coding_status(unmapped),
        alerts=label_alerts(incidents, alert_rules, year, month),
        shared=shared)


__all__ = ["MonthlyReports", "monthly_reports", "COUNTS"]
