"""Wide <-> long reshaping (``pivot_longer`` / ``pivot_wider``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            names_to: str = "name", values_to: str = "value") -> DataFrame:
    """One row per (ids, measure): a narrow Expand, no shuffle."""
    return df.unpivot(list(ids), list(values), names_to, values_to)


def to_wide(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
            names: Sequence[str], agg: str = "sum") -> DataFrame:
    """One row per ids with one column per listed name.

    The names are given explicitly, so Spark needs no extra job to discover
    them and the output schema is stable even when a name has no rows.
    """
    fn = getattr(F, agg)
    return df.groupBy(*ids).pivot(names_from, list(names)).agg(fn(F.col(values_from)))
