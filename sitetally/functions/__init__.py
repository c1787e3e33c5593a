"""Column expressions: measures, sum modes, null rules, spreadsheet dates."""

from sitetally.functions.dates import (in_period, month_name, period_bounds, previous_period,
                                       serial_to_date)
from sitetally.functions.measures import (Measure, count_measure, hours_measure, hours_to_double,
                                          null_to_zero, sum_hours, zero_to_null)

__all__ = [
    "Measure",
    "count_measure",
    "hours_measure",
    "in_period",
    "month_name",
    "null_to_zero",
    "period_bounds",
    "previous_period",
    "serial_to_date",
    "sum_hours",
    "zero_to_null",
]
