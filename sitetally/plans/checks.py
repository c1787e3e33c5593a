"""Run-time checks: unmapped keys, coding status, label alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitetally.operators.mapping import DEFAULT_BROADCAST_ROWS, fits_broadcast, unmapped_keys
from sitetally.plans.incidents import INCIDENT_KEY, period_incidents
from sitetally.sources.literal import literal_table

# Report messages.
ALL_CODED = "All locations appear to be coded for"
NEW_KEY_WARNING = "New key: add it to the mapping"
HQ_LOCATION = "HEADQUARTERS - HQ"
HQ_MESSAGE = ("There is a HQ incident this month. Please convert 'HEADQUARTERS - HQ' to "
              "'HEADQUARTERS - SALES' or 'HEADQUARTERS - ADMIN', save the file, and reupload.")


def unmapped_report(facts: DataFrame, mapping: DataFrame, keys: Sequence[str],
                    warning: str = NEW_KEY_WARNING,
                    broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``warning, <keys>``: one row per distinct non-NULL key without mapping.

    The schema is the same whether or not any key is missing.
    """
    missing = unmapped_keys(facts, mapping, keys, broadcast_rows)
    return missing.select(F.lit(warning).alias("warning"), *keys)


def coding_status(unmapped: DataFrame) -> DataFrame:
    """One row: ``unmapped_count`` and a status text (global aggregate, so the
    row exists for an empty input)."""
    n = F.count(F.lit(1))
    return unmapped.agg(n.alias("unmapped_count")).select(
        "unmapped_count",
        F.when(F.col("unmapped_count") == 0, F.lit(ALL_CODED))
         .otherwise(F.format_string("%d unmapped keys", F.col("unmapped_count")))
         .alias("status"))


# The rule that always applies: (column, value, message).
DEFAULT_RULES = ((INCIDENT_KEY, HQ_LOCATION, HQ_MESSAGE),)
RULE_SCHEMA = "column string, value string, message string"


def default_rules(spark: SparkSession) -> DataFrame:
    return literal_table(spark, DEFAULT_RULES, RULE_SCHEMA)


def label_alerts(incidents: DataFrame, rules: DataFrame | None = None, year: int | None = None,
                 month: str | int | None = None, date_col: str = "loss_date",
                 broadcast_rows: int = DEFAULT_BROADCAST_ROWS, defaults: bool = True) -> DataFrame:
    """Rules ``(column, value, message)`` that match at least one incident of the
    period; 0..n rows.  The headquarters rule always applies unless ``defaults`` is
    false.

    Every incident is read once: its text columns become (column, value) pairs,
    the pairs are joined map-side to the rules and the matches made distinct (combined
    before the shuffle, so a value holding most incidents is one row per partition).  A rule
    whose column the incidents lack matches nothing.
    """
    inc = period_incidents(incidents, year, month, date_col)
    texts = [f.name for f in inc.schema.fields if isinstance(f.dataType, StringType)]
    all_rules = default_rules(incidents.sparkSession) if defaults or rules is None else None
    if rules is not None:
        own = rules.select("column", "value", "message")
        all_rules = own if all_rules is None else own.unionByName(all_rules)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in texts]) \
        if texts else F.array().cast("array<struct<column:string,value:string>>")
    seen = inc.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null")
    # the default rules are a handful, so the given ones decide
    fits = fits_broadcast(all_rules if rules is None else rules, broadcast_rows)
    r = F.broadcast(all_rules) if fits else all_rules
    return (seen.join(r, on=["column", "value"], how="inner")
            .select("column", "value", "message").distinct())
