"""Declared schemas of the inputs and reports (DDL strings).

Inputs are read with these schemas (no inference) after the source headers
are normalised; reports are checked against them in the tests.
"""

# Fact inputs after ingest and typing.
EXEMPT_HOURS = "l4_org_unit string, personnel_area string, hours decimal(28,9)"
NONEXEMPT_HOURS = "cost_center string, wage_type string, hours decimal(28,9)"
INCIDENTS_TEXT = "location string, loss_date_raw string, lost_days_raw string"
INCIDENTS = "location string, loss_date date, lost_days double"
EXPENDITURES = "cost_center string, hours decimal(28,9)"

# Mapping and rule tables.
EXEMPT_MAP = "l4_org_unit string, personnel_area string, facility string, section string"
NONEXEMPT_MAP = "cost_center string, facility string, section string"
LOCATION_MAP = "location string, facility string, section string"
ALERT_RULES = "column string, value string, message string"

# Raw sheet rows written by the workbook ingest.
RAW_SHEET = ("path string, sheet string, sheet_no int, row_index bigint, "
             "cells array<string>")
# What the ingest knows of a sheet when it has decoded it: its last row and first rows.
SHEET_INDEX = ("path string, sheet string, sheet_no int, last bigint, "
               "tops array<struct<row_index:bigint,cells:array<string>>>")

# Reports (labelled form; a leading period column is added with ``by``).
HOURS_REPORT = "facility string, section string, row_kind string, hours double"
INCIDENT_REPORT = ("facility string, section string, row_kind string, "
                   "or_cases bigint, lt_cases bigint")
COMBINED_REPORT = ("facility string, section string, row_kind string, hours double, "
                   "or_cases bigint, lt_cases bigint")
UNMAPPED_EXEMPT = "warning string, l4_org_unit string, personnel_area string"
CODING_STATUS = "unmapped_count bigint, status string"
EXPENDITURE_REPORT = "cost_center string, hours double"
