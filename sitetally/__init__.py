"""sitetally: monthly site hours and incident reports as Spark DataFrame plans.

Fact tables (payroll hours, incidents) are mapped to (facility, section)
through small mapping tables, aggregated once at section level, and rolled
up into section, facility and grand-total rows.  Everything is a lazy
DataFrame plan; nothing is collected to the driver.
"""

from sitetally.plans.hours import exempt_report, hours_report, nonexempt_report
from sitetally.plans.incidents import combined_report, incident_report
from sitetally.plans.checks import coding_status, label_alerts, unmapped_report
from sitetally.plans.expenditures import expenditure_report
from sitetally.plans.monthly import monthly_reports
from sitetally.operators.mapping import label_drift, map_keys, unmapped_keys, validate_mapping
from sitetally.operators.levels import join_reports, label_levels, order_report, three_level
from sitetally.sinks import display_view, write_report
from sitetally.sources.workbook import ingest_workbooks

__all__ = [
    "coding_status",
    "combined_report",
    "display_view",
    "exempt_report",
    "expenditure_report",
    "hours_report",
    "incident_report",
    "ingest_workbooks",
    "join_reports",
    "label_alerts",
    "label_drift",
    "label_levels",
    "map_keys",
    "monthly_reports",
    "nonexempt_report",
    "order_report",
    "three_level",
    "unmapped_keys",
    "unmapped_report",
    "validate_mapping",
    "write_report",
]
