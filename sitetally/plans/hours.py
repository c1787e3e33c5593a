"""Hours reports: exempt, non-exempt and their combination.

Population rules (reference semantics):

* exempt: lenient section sums; facts without a mapping are dropped (and
  reported by ``unmapped_report``); every mapping pair is reported, with 0
  when it has no hours;
* non-exempt: excluded wage types removed first (a NULL wage type is removed
  too, as ``!=`` is not true for NULL); strict section sums (one NULL hour
  makes the section NULL); facts without a mapping stay in the report under
  a NULL facility and count in the grand total;
* all facility and grand totals are lenient sums of section values.

Per-population reports show 0 as NULL; the combined hours report adds the
two populations section by section with NULL read as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitetally.functions.exact import snapped
from sitetally.functions.measures import HOURS_VALUE, hours_measure, hours_to_double, null_to_zero, zero_to_null
from sitetally.operators.levels import label_levels, three_level
from sitetally.operators.mapping import (LABELS, DEFAULT_BROADCAST_ROWS, attach_pairs,
                                         finish_states, require_columns,
                                         scaffold_states, section_states)

# Wage types left out of non-exempt hours by default.
EXCLUDED_WAGE_TYPES = ("3C Sick Pay", "3C Vacation Pay", "3C Vac Payout SupTx")

EXEMPT_KEYS = ("l4_org_unit", "personnel_area")
NONEXEMPT_KEY = "cost_center"


def exclude_wage_types(facts: DataFrame, excluded: Sequence[str],
                       wage_col: str = "wage_type") -> DataFrame:
    """Chained ``wage_type != x`` filters; NULL wage types are dropped."""
    if not excluded:
        return facts
    return facts.filter(~F.col(wage_col).isin(*excluded))


def nonexempt_sections(facts: DataFrame, mapping: DataFrame,
                       excluded_wage_types: Sequence[str] = EXCLUDED_WAGE_TYPES,
                       by: Sequence[str] = (), key: str = NONEXEMPT_KEY,
                       wage_col: str = "wage_type", hours_col: str = "hours",
                       broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Exact section hours (strict sum; NULL facility for unmapped keys)."""
    require_columns(facts, [*by, key, wage_col, hours_col], "non-exempt hours")
    measure = hours_measure("hours", hours_col, "strict", facts.schema[hours_col].dataType)
    kept = exclude_wage_types(facts, excluded_wage_types, wage_col)
    states = section_states(kept, mapping, [key], [measure], by, unmapped="keep",
                            broadcast_rows=broadcast_rows)
    return finish_states(states, [measure], by)


def exempt_sections(facts: DataFrame, mapping: DataFrame, by: Sequence[str] = (),
                    keys: Sequence[str] = EXEMPT_KEYS, hours_col: str = "hours",
                    broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Exact section hours (lenient sum; every mapping pair present).

    Facts are mapped with a left join; the unmapped (NULL facility) group is
    dropped after aggregation, once the zero rows of every mapping pair have
    been added for each period (including periods whose facts are all
    unmapped).
    """
    by = list(by)
    require_columns(facts, [*by, *keys, hours_col], "exempt hours")
    measure = hours_measure("hours", hours_col, "lenient", facts.schema[hours_col].dataType)
    states = section_states(facts, mapping, keys, [measure], by, unmapped="keep",
                            broadcast_rows=broadcast_rows)
    states = scaffold_states(states, mapping, [measure], by, broadcast_rows=broadcast_rows)
    return finish_states(states, [measure], by)


def finish_hours(levels: DataFrame, by: Sequence[str] = (), zero_as_null: bool = True,
                 labels: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """Hours as shown; zero -> NULL for per-population reports."""
    exact = zero_to_null("hours") if zero_as_null else F.col("hours")
    out = levels.select(*by, *LABELS, "row_kind", *extra,
                        hours_to_double(exact).alias("hours"))
    return label_levels(out) if labels else out


def nonexempt_report(facts: DataFrame, mapping: DataFrame,
                     excluded_wage_types: Sequence[str] = EXCLUDED_WAGE_TYPES,
                     by: Sequence[str] = (), labels: bool = True, **kw) -> DataFrame:
    """Non-exempt hours report: section, facility and grand rows."""
    sections = nonexempt_sections(facts, mapping, excluded_wage_types, by, **kw)
    return finish_hours(three_level(sections, ["hours"], by), by, labels=labels)


def exempt_report(facts: DataFrame, mapping: DataFrame, by: Sequence[str] = (),
                  labels: bool = True, **kw) -> DataFrame:
    """Exempt hours report: every mapping pair, facility and grand rows."""
    sections = exempt_sections(facts, mapping, by, **kw)
    return finish_hours(three_level(sections, ["hours"], by), by, labels=labels)


def combined_hour_sections(exempt: DataFrame, exempt_map: DataFrame,
                           nonexempt: DataFrame, nonexempt_map: DataFrame,
                           excluded_wage_types: Sequence[str] = EXCLUDED_WAGE_TYPES,
                           by: Sequence[str] = (),
                           broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Section hours of both populations added (NULL read as 0), exact.

    Carries ``src_rank`` (0: section present in the non-exempt report, 1:
    exempt only) for the report order.  Equivalent to the NULL-safe full
    outer join of the two finished reports followed by ``x + y``, but done
    as one union + aggregation over section rows.
    """
    by = list(by)
    ne = nonexempt_sections(nonexempt, nonexempt_map, excluded_wage_types, by,
                            broadcast_rows=broadcast_rows)
    require_columns(exempt, [*by, *EXEMPT_KEYS, "hours"], "exempt hours")
    measure = hours_measure("hours", "hours", "lenient", exempt.schema["hours"].dataType)
    ex_states = section_states(exempt, exempt_map, EXEMPT_KEYS, [measure], by,
                               unmapped="keep", broadcast_rows=broadcast_rows)
    complete = F.col(LABELS[0]).isNotNull() & F.col(LABELS[1]).isNotNull()
    ex = finish_states(ex_states, [measure], by).withColumn("src_rank", F.lit(1))
    if not by:
        # the regroup below also merges the zero rows of the mapping's pairs
        zero = (exempt_map.select(*LABELS).filter(F.col(LABELS[0]).isNotNull())
                .withColumns({"hours": F.lit(0).cast(HOURS_VALUE), "src_rank": F.lit(1)}))
        both = (ne.withColumn("src_rank", F.lit(0))
                .unionByName(ex.filter(complete)).unionByName(zero))
    else:
        # every period of either population gets the exempt mapping's zero rows;
        # both populations are read once (pairs are attached in the same pass)
        ex = ex.withColumn("_keep", complete)
        union = (ne.withColumn("src_rank", F.lit(0)).withColumn("_keep", F.lit(True))
                 .unionByName(ex))
        both = (attach_pairs(union, exempt_map, by, {"hours": F.lit(0), "src_rank": F.lit(1),
                                                     "_keep": F.lit(True)},
                             broadcast_rows=broadcast_rows)
                .filter("_keep").drop("_keep"))
    # at most one value of each population, so the plain sum does not depend on an order
    total = snapped(F.sum("hours"), 2, F.max(F.abs("hours")))
    return (both.groupBy(*by, *LABELS)
            .agg(null_to_zero(total).alias("hours"),
                 F.min("src_rank").alias("src_rank")))


def hours_report(exempt: DataFrame, exempt_map: DataFrame, nonexempt: DataFrame,
                 nonexempt_map: DataFrame,
                 excluded_wage_types: Sequence[str] = EXCLUDED_WAGE_TYPES,
                 by: Sequence[str] = (), labels: bool = True, keep_rank: bool = False,
                 broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Monthly hours table: exempt + non-exempt per section, facility, grand."""
    sections = combined_hour_sections(exempt, exempt_map, nonexempt, nonexempt_map,
                                      excluded_wage_types, by, broadcast_rows)
    levels = three_level(sections, ["hours"], by, rank_col="src_rank")
    extra = ["src_rank"] if keep_rank else []
    return finish_hours(levels, by, zero_as_null=False, labels=labels, extra=extra)
