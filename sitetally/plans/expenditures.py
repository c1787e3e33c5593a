"""Expenditure hours by cost centre (strict sum, no mapping)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sitetally.functions.measures import hours_measure, hours_to_double
from sitetally.operators.mapping import fact_states, finish_states


def expenditure_report(facts: DataFrame, key: str = "cost_center", hours_col: str = "hours",
                       by: Sequence[str] = ()) -> DataFrame:
    """``cost_center, hours``: one row per cost centre; NULL when any row of the
    centre has no hours."""
    m = hours_measure("hours", hours_col, mode="strict", dtype=facts.schema[hours_col].dataType)
    states = fact_states(facts, [*by, key], [m])
    return finish_states(states, [m], by, [key]).select(*by, key, hours_to_double("hours").alias("hours"))
