"""Measures and their aggregation rules.

A measure is aggregated in two steps so that any fact volume reduces to a
few partial columns before a shuffle:

* ``partials``: aggregate expressions over fact rows (map-side combinable);
* ``section``: the section value computed from the summed partials.

Hours are summed exactly.  Doubles (and text read as such) become integer limbs by
exponent (``exact``), so a measure of hours has one more grouping column, the bin;
``section`` values are doubles, rounded once.  Decimals are summed as decimals.  Sums
are independent of partition and row order, so a report is reproducible no matter how
Spark splits the input, and no size of hours is left out.  Totals add up section values
in the same way.

Sum modes (reference semantics):

* ``lenient``: NULL values are skipped and an all-NULL or empty group is 0;
* ``strict``: any NULL value in a group makes the group NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

from sitetally.functions.exact import bin_of, digit_struct, exact_value, finite, limb_columns, scaled

HOURS_DECIMAL = "decimal(28,9)"
HOURS_SUM = "decimal(38,9)"
HOURS_VALUE = "double"              # type of section values and totals


def sum_hours(col: Column | str, dtype: DataType | None = None) -> Column:
    """Sum of hours as one aggregate, a decimal of nine digits (NULL values are skipped).

    Exact for decimals; doubles are read to nine decimals, and one that no such decimal
    holds is an error.  ``hours_measure`` has neither limit.
    """
    c = F.col(col) if isinstance(col, str) else col
    if not isinstance(dtype, DecimalType):
        c = finite(c)
    return F.sum(c.cast(HOURS_DECIMAL)).cast(HOURS_SUM)


def hours_to_double(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("double")


def zero_to_null(col: Column | str) -> Column:
    """``x[x == 0] <- NA`` on a measure column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(c, F.lit(0))


def null_to_zero(col: Column | str) -> Column:
    """``replace(is.na(.), 0)`` on a measure column (keys are never touched)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(0).cast(HOURS_VALUE))


@dataclass(frozen=True)
class Measure:
    """A named measure: partial aggregates over facts and its section value.

    ``partials`` maps partial column name -> aggregate expression over fact
    rows.  Every partial merges by ``merge`` (``sum`` if not named there), so the same
    partials can be merged again after a key-level pre-aggregation.  A
    ``binned`` measure has one state a bin: ``prepared`` names, step by step, the columns
    that its partials read (the bin among them), and ``gathered`` are aggregates that
    bring a group's bins together.  ``value`` is the section value, from the partials or
    what was gathered.
    """

    name: str
    partials: tuple[tuple[str, Column], ...]
    value: Column
    prepared: tuple[dict[str, Column], ...] = ()
    merge: tuple[tuple[str, Callable], ...] = ()
    gathered: tuple[tuple[str, Column], ...] = ()

    @property
    def section(self) -> Column:
        return self.value.alias(self.name)

    def partial_names(self) -> list[str]:
        return [n for n, _ in self.partials]

    @property
    def binned(self) -> bool:
        return bool(self.prepared)

    def merged(self) -> list[Column]:
        """Aggregates that merge partials of the same name."""
        how = dict(self.merge)
        return [how.get(n, F.sum)(n).alias(n) for n in self.partial_names()]


BIN = "_bin"                        # column of a binned measure's states


def hours_measure(name: str, value: Column | str, mode: str = "lenient",
                  dtype: DataType | None = None) -> Measure:
    """Exact sum of hours under a sum mode (``lenient`` or ``strict``).

    ``dtype`` is the type of the hours column; decimals are then never passed
    through a double before they are summed.
    """
    if mode not in ("lenient", "strict"):
        raise ValueError(f"unknown sum mode {mode!r}")
    c = F.col(value) if isinstance(value, str) else value
    rows, valued = f"{name}__rows", f"{name}__valued"

    def finished(total: Column) -> Column:
        return F.when(F.col(rows) == F.col(valued), total) if mode == "strict" else total

    if isinstance(dtype, DecimalType):
        total = f"{name}__total"
        partials = ((rows, F.count(F.lit(1))), (valued, F.count(c)), (total, F.sum(c)))
        return Measure(name, partials, finished(F.coalesce(F.col(total).cast("double"), F.lit(0.0))))
    x, y = f"{name}__x", f"{name}__y"
    prepared = ({x: finite(c)}, {BIN: bin_of(F.col(x))}, {y: scaled(F.col(x), F.col(BIN))})
    limbs = limb_columns(F.col(x), F.col(y))
    names = [f"{name}__limb{k}" for k in range(len(limbs))]
    most, bins = f"{name}__most", f"{name}__bins"
    partials = ((rows, F.count(F.lit(1))), (valued, F.count(x)), (most, F.max(F.abs(x))),
                *((n, F.sum(limb)) for n, limb in zip(names, limbs)))
    digits = digit_struct(F.col(BIN), [F.col(n) for n in names])
    gathered = ((rows, F.sum(rows)), (valued, F.sum(valued)), (most, F.max(most)),
                (bins, F.collect_list(F.when(F.col(BIN).isNotNull(), digits))))
    return Measure(name, partials, finished(exact_value(bins, valued, most)),
                   prepared, ((most, F.max),), gathered)


def count_measure(name: str, condition: Column | None = None,
                  absent_as_null: bool = False) -> Measure:
    """Row count (``n()``), optionally only rows where ``condition`` is true.

    With ``absent_as_null`` a section with no qualifying row is NULL, which is
    what a left join of a filtered count onto the full count produces.
    """
    hits = f"{name}__n"
    agg = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    section = F.col(hits)
    if absent_as_null:
        section = F.nullif(section, F.lit(0))
    return Measure(name, ((hits, agg),), section)
