"""

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame that reads
whole tables.  ``sitetally.oracle`` holds the equivalent DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetally.functions.dates import in_period, month_name
from sitetally.functions.measures import count_measure, hours_measure, hours_to_double
from sitetally.operators.levels import label_levels, order_report
from sitetally.operators.mapping import fact_states, finish_states, validate_mapping
from sitetally.operators.reshape import to_long, to_wide
from sitetally.plans.checks import coding_status, label_alerts, unmapped_report
from sitetally.plans.expenditures import expenditure_report
from sitetally.plans.hours import (EXEMPT_KEYS, combined_hour_sections, exclude_wage_types,
                                   exempt_report, exempt_sections, hours_report,
                                   nonexempt_report, nonexempt_sections)
from sitetally.plans.incidents import combined_report, incident_report, incident_sections
from sitetally.sources import roles as R
from sitetally.sources.sheets import (drop_footer, project_fields, promote_header, sheet_table,
                                      skip_rows)
from sitetally.sinks import display_view
from sitetally.sources.tables import rejected_cells, typed_incidents

YEAR, MONTH = R.PERIOD
EXCL = R.EXCLUDED_FLAGS


def _hours_inputs(spark: SparkSession, d: str):
    return (R.exempt_facts(spark, d), R.exempt_map(spark),
            R.nonexempt_facts(spark, d), R.nonexempt_map(spark))


def nonexempt_report_q(spark, d):
    return nonexempt_report(R.nonexempt_facts(spark, d), R.nonexempt_map(spark), EXCL)


def nonexempt_sections_strict(spark, d):
    s = nonexempt_sections(R.nonexempt_facts(spark, d), R.nonexempt_map(spark), EXCL)
    return s.select("facility", "section", hours_to_double("hours").alias("hours"))


def wage_exclusion_nulls(spark, d):
    kept = exclude_wage_types(R.nonexempt_facts(spark, d, null_wage=True), EXCL)
    measures = [count_measure("kept_rows"), hours_measure("hours", "hours")]
    return finish_states(fact_states(kept, ["wage_type"], measures), measures, (), ["wage_type"])


def exempt_sections_grid(spark, d):
    s = exempt_sections(R.exempt_facts(spark, d), R.exempt_map(spark))
    return s.select("facility", "section", hours_to_double("hours").alias("hours"))


def exempt_report_q(spark, d):
    return exempt_report(R.exempt_facts(spark, d), R.exempt_map(spark))


def hours_report_q(spark, d):
    return hours_report(*_hours_inputs(spark, d), EXCL)


def serial_dates(spark, d):
    t = typed_incidents(R.incidents_text(spark, d))
    return t.select("o_orderkey", F.date_format("loss_date", "yyyy-MM-dd").alias("loss_date"),
                    month_name("loss_date").alias("loss_month"),
                    F.year("loss_date").cast("string").alias("loss_year"))


def month_filter(spark, d):
    o = R.table(spark, d, "orders")
    return o.filter(in_period("o_orderdate", YEAR, MONTH)).select("o_orderkey", "o_orderdate")


def incident_sections_q(spark, d):
    t = typed_incidents(R.incidents_text(spark, d))
    return incident_sections(t, R.location_map(spark), YEAR, MONTH)


def incident_report_q(spark, d):
    return incident_report(R.incidents(spark, d), R.location_map(spark), YEAR, MONTH)


def _typed_sections(spark, d):
    return incident_sections(R.incidents(spark, d), R.location_map(spark), YEAR, MONTH)


def incident_long(spark, d):
    return to_long(_typed_sections(spark, d), ["facility", "section"],
                   ["or_cases", "lt_cases"], "incident_type", "cases")


def incident_wide(spark, d):
    long = incident_long(spark, d)
    fac = long.groupBy("facility", "incident_type").agg(
        F.coalesce(F.sum("cases"), F.lit(0).cast("long")).alias("cases"))
    return to_wide(fac, ["facility"], "incident_type", "cases", ["or_cases", "lt_cases"])


def incident_on_hours_layout(spark, d):
    hs = combined_hour_sections(*_hours_inputs(spark, d), EXCL)
    return incident_report(R.incidents(spark, d), R.location_map(spark), YEAR, MONTH,
                           hours_sections=hs)


def combined_report_q(spark, d):
    return combined_report(*_hours_inputs(spark, d), R.incidents(spark, d),
                           R.location_map(spark), YEAR, MONTH, EXCL)


def unmapped_keys_q(spark, d):
    return unmapped_report(R.exempt_facts(spark, d), R.exempt_map(spark), EXEMPT_KEYS)


def unmapped_status(spark, d):
    return coding_status(unmapped_keys_q(spark, d))


def label_alerts_q(spark, d):
    return label_alerts(R.incidents(spark, d), R.alert_rules(spark), YEAR, MONTH)


def expenditure_by_center(spark, d):
    return expenditure_report(R.nonexempt_facts(spark, d), "cost_center", "hours")


def sub_cent_expenditures(spark, d):
    """Hours finer than a cent, which must not be rounded before the sum."""
    rows = R.sub_cent_hours(spark, d)
    return expenditure_report(rows, "cost_center", "hours").withColumn("hours", F.round("hours", 4))


def expenditures_of_any_size(spark, d):
    """Hours from 1e-12 to 1e300 that cancel, exceed 64-bit counts or hardly count."""
    return expenditure_report(R.extreme_hours(spark, d), "cost_center", "hours")


def exempt_report_null_section(spark, d):
    """A mapping pair without a section is shown, but empty."""
    return exempt_report(R.exempt_facts(spark, d), R.exempt_map_null_section(spark))


def exempt_report_by_period_joined(spark, d):
    """The per-period report when the mapping is too large to send along."""
    return exempt_report(R.exempt_facts(spark, d), R.exempt_map(spark), by=["period_year"],
                         broadcast_rows=0)


def nonexempt_report_blank_keys(spark, d):
    """A mapping with blank and NULL keys, which match nothing."""
    return nonexempt_report(R.nonexempt_facts(spark, d), R.nonexempt_map_blank_keys(spark), EXCL)


def sheet_header_footer(spark, d):
    return sheet_table(R.indexed_sheet_rows(spark, d),
                       {"priority": "Priority", "status": "Status", "customer": "Customer"},
                       skip=2, footer=3)


def sheet_header_footer_steps(spark, d):
    body = drop_footer(promote_header(skip_rows(R.sheet_rows(spark, d), 2)), 3)
    return project_fields(body, {"priority": "Priority", "status": "Status",
                                 "customer": "Customer"})


def mapping_violations(spark, d):
    return validate_mapping(R.part_mapping(spark, d), ["cost_center"])


def report_order(spark, d):
    rep = hours_report(*_hours_inputs(spark, d), EXCL, labels=False, keep_rank=True)
    ranked = label_levels(order_report(rep, rank_col="src_rank"))
    return ranked.select("facility", "section", "row_kind", "hours", "report_rank")


def hours_report_by_period(spark, d):
    return hours_report(*_hours_inputs(spark, d), EXCL, by=["period_year"])


def incident_report_by_period(spark, d):
    return incident_report(R.incidents(spark, d), R.location_map(spark),
                           by=["period_year", "period_month"])


def nonexempt_report_preaggregated(spark, d):
    """Same report through the fallback strategy used when a mapping is too
    large to broadcast: facts pre-aggregated by key, then a shuffle join."""
    return nonexempt_report(R.nonexempt_facts(spark, d), R.nonexempt_map(spark), EXCL,
                            broadcast_rows=0)


def exempt_report_by_period(spark, d):
    return exempt_report(R.exempt_facts(spark, d), R.exempt_map(spark), by=["period_year"])


def rejected_cells_q(spark, d):
    return rejected_cells(R.incidents_text(spark, d),
                          {"loss_date_raw": "serial_date", "lost_days_raw": "double"})


def hours_display(spark, d):
    rep = hours_report(*_hours_inputs(spark, d), EXCL, labels=False, keep_rank=True)
    return display_view(rep, rank_col="src_rank")


def combined_report_by_period(spark, d):
    return combined_report(*_hours_inputs(spark, d), R.incidents(spark, d),
                           R.location_map(spark), excluded_wage_types=EXCL, by=["period_year"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "nonexempt_report": nonexempt_report_q,
    "nonexempt_sections_strict": nonexempt_sections_strict,
    "wage_exclusion_nulls": wage_exclusion_nulls,
    "exempt_sections_grid": exempt_sections_grid,
    "exempt_report": exempt_report_q,
    "hours_report": hours_report_q,
    "serial_dates": serial_dates,
    "month_filter": month_filter,
    "incident_sections": incident_sections_q,
    "incident_report": incident_report_q,
    "incident_long": incident_long,
    "incident_wide": incident_wide,
    "incident_on_hours_layout": incident_on_hours_layout,
    "combined_report": combined_report_q,
    "unmapped_keys": unmapped_keys_q,
    "unmapped_status": unmapped_status,
    "label_alerts": label_alerts_q,
    "expenditure_by_center": expenditure_by_center,
    "sub_cent_expenditures": sub_cent_expenditures,
    "expenditures_of_any_size": expenditures_of_any_size,
    "exempt_report_null_section": exempt_report_null_section,
    "exempt_report_by_period_joined": exempt_report_by_period_joined,
    "nonexempt_report_blank_keys": nonexempt_report_blank_keys,
    "sheet_header_footer": sheet_header_footer,
    "sheet_header_footer_steps": sheet_header_footer_steps,
    "mapping_violations": mapping_violations,
    "report_order": report_order,
    "hours_report_by_period": hours_report_by_period,
    "incident_report_by_period": incident_report_by_period,
    "nonexempt_report_preaggregated": nonexempt_report_preaggregated,
    "exempt_report_by_period": exempt_report_by_period,
    "rejected_cells": rejected_cells_q,
    "hours_display": hours_display,
    "combined_report_by_period": combined_report_by_period,
}
