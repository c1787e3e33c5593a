"""Three-level report (section, facility, grand) and report order.

A report frame has columns ``[*by, facility, section, row_kind, *measures]``
with ``row_kind`` in ``section`` / ``facility`` / ``grand``.  Facility rows
carry a NULL section and the grand row NULL facility and section until
``label_levels`` writes the ``Total`` labels, so a real section called
``A`` or ``Total`` and a real NULL (unmapped) facility are never confused
with a total row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sitetally.functions.measures import BIN, hours_measure

SECTION, FACILITY, GRAND = "section", "facility", "grand"

# Fixed value: label written into facility/section of total rows.
TOTAL_LABEL = "Total"

# Roll-up rules for a measure from section values to facility and grand rows:
#   lenient: sum skipping NULL, empty -> 0 (sum(x, na.rm = TRUE));
#   sum:     facility NULL when all its sections are NULL, grand as lenient.
ROLLUPS = ("lenient", "sum")


def _level_value(name: str, rule: str, kind: Column) -> Column:
    """Value of a measure on a section, facility or grand row of the
    grouping-sets aggregate (which holds plain sums)."""
    if rule not in ROLLUPS:
        raise ValueError(f"unknown roll-up rule {rule!r}")
    s = F.col(name)
    zero = F.coalesce(s, F.lit(0))
    if rule == "lenient":
        return F.when(kind == SECTION, s).otherwise(zero).alias(name)
    return F.when(kind == GRAND, zero).otherwise(s).alias(name)


def three_level(sections: DataFrame, measures: Sequence[str] | Mapping[str, str],
                by: Sequence[str] = (), facility: str = "facility", section: str = "section",
                rank_col: str | None = None) -> DataFrame:
    """Hand-written ROLLUP of section rows into facility and grand rows.

    Totals are sums of *section values* (never of raw facts), so a strict
    NULL section contributes nothing to its facility.  One ``groupingSets``
    aggregate (a single Expand and exchange over the small section frame)
    yields all three levels.  A grouping-sets aggregate returns no grand row
    for empty input, so without ``by`` one marker row is added that only
    the grand set sees: the report always has exactly one grand row.

    A measure of doubles is summed exactly (``exact``), in any order.

    ``sections`` holds one row per (by, facility, section).  ``rank_col``, if
    given, is an integer column rolled up with ``min`` (the source rank used
    by ``order_report``); the grand row gets 0.
    """
    rules = dict(measures) if isinstance(measures, Mapping) else {m: "lenient" for m in measures}
    by = list(by)
    names = list(rules)
    types = {f.name: f.dataType for f in sections.schema.fields}
    exact = [n for n in names if isinstance(types[n], DoubleType)]
    if len(exact) > 1:
        raise ValueError(f"one measure of doubles at a time, not {exact}")
    extra = [rank_col] if rank_col else []
    cols = [facility, section, *names, *extra]
    base = sections.select(*by, *cols, F.lit(False).alias("_pad"))
    if not by:
        pad = base.sparkSession.range(1).select(
            *[F.lit(None).cast(types[c]).alias(c) for c in cols], F.lit(True).alias("_pad"))
        base = base.unionByName(pad)
    # section values that are doubles are added as limbs, one row a level and exponent bin
    plain = [n for n in names if n not in exact]
    measure = hours_measure(exact[0], exact[0]) if exact else None
    bins = [BIN] if exact else []
    for columns in measure.prepared if measure else ():
        base = base.withColumns(columns)
    sets = [[*by, facility, section, "_pad", *bins], [*by, facility, "_pad", *bins], [*by, *bins]]
    agg = base.groupingSets(sets, *by, facility, section, "_pad", *bins).agg(
        *[F.sum(n).alias(n) for n in plain],
        *[c.alias(n) for n, c in (measure.partials if measure else ())],
        *[F.min(c).alias(c) for c in extra],
        F.grouping(section).alias("_gs"),
        F.grouping(facility).alias("_gf"))
    kind = (F.when(F.col("_gs") == 0, F.lit(SECTION))
            .when(F.col("_gf") == 0, F.lit(FACILITY)).otherwise(F.lit(GRAND)))
    kept = agg.filter((F.col("_gf") == 1) | ~F.col("_pad")).withColumn("row_kind", kind)
    if exact:
        # the section, facility and period keys of a row name it together with its kind
        kept = kept.groupBy(*by, facility, section, "row_kind").agg(
            *[F.sum(n).alias(n) for n in plain], *[F.min(c).alias(c) for c in extra],
            *[c.alias(n) for n, c in measure.gathered])
        some = F.col(f"{exact[0]}__valued") > 0
        kept = kept.withColumn(exact[0], F.when(some, measure.value))
    k = F.col("row_kind")
    return kept.select(
        *by, facility, section, "row_kind",
        *[_level_value(n, r, k) for n, r in rules.items()],
        *[F.when(k == GRAND, F.lit(0)).otherwise(F.col(c)).alias(c) for c in extra])


def label_levels(report: DataFrame, facility: str = "facility",
                 section: str = "section") -> DataFrame:
    """Write ``Total`` into the facility/section of total rows (display form)."""
    kind = F.col("row_kind")
    return report.withColumns({
        facility: F.when(kind == GRAND, F.lit(TOTAL_LABEL)).otherwise(F.col(facility)),
        section: F.when(kind == SECTION, F.col(section)).otherwise(F.lit(TOTAL_LABEL)),
    })


def order_keys(facility: str = "facility", section: str = "section",
               rank_col: str | None = None) -> list[Column]:
    """Report order on an unlabeled report.

    Mapped facilities A..Z, each as: (source rank,) facility total, sections
    A..Z with a NULL section last; then the grand total; then the unmapped
    (NULL) facility block.  The source rank reproduces the row order of the
    stable re-sort after the report joins: rows present in the first report
    come before rows only present in the second, and so on.
    """
    kind = F.col("row_kind")
    unmapped = F.col(facility).isNull() & (kind != GRAND)
    keys = [unmapped.asc(), (kind == GRAND).asc(), F.col(facility).asc_nulls_last()]
    if rank_col:
        keys.append(F.col(rank_col).asc())
    keys += [(kind == SECTION).asc(), F.col(section).asc_nulls_last()]
    return keys


def order_report(report: DataFrame, by: Sequence[str] = (), facility: str = "facility",
                 section: str = "section", rank_col: str | None = None,
                 rank_name: str = "report_rank") -> DataFrame:
    """Add ``report_rank`` (1-based row position within each period).

    The window is partitioned by the period columns; a report holds at most
    one row per mapping pair and facility per period, so each window
    partition is bounded by the mapping size.
    """
    w = Window.partitionBy(*by).orderBy(*order_keys(facility, section, rank_col))
    return report.withColumn(rank_name, F.row_number().over(w))


def join_reports(left: DataFrame, right: DataFrame, by: Sequence[str] = (),
                 facility: str = "facility", section: str = "section",
                 how: str = "full") -> DataFrame:
    """NULL-safe outer join of two report frames on (by, facility, section,
    row_kind); key columns are coalesced.  NULL keys match each other, as the
    reference's joins match NA with NA.
    """
    keys = [*by, facility, section, "row_kind"]
    lk = left.select(*[F.col(k).alias(f"_l_{k}") for k in keys],
                     *[c for c in left.columns if c not in keys])
    rk = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                      *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        term = F.col(f"_l_{k}").eqNullSafe(F.col(f"_r_{k}"))
        cond = term if cond is None else cond & term
    joined = lk.join(rk, cond, how)
    key_cols = [F.coalesce(F.col(f"_l_{k}"), F.col(f"_r_{k}")).alias(k) for k in keys]
    rest = [c for c in joined.columns if not c.startswith(("_l_", "_r_"))]
    return joined.select(*key_cols, *rest)
