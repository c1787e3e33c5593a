"""Report output: files and a display view.

Reports are small (at most one row per mapping pair and facility per
period), so the display view and a single-file CSV are safe; the Parquet
sink partitions by period and overwrites only the periods being written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitetally.operators.levels import FACILITY, GRAND, label_levels, order_report


def write_report(report: DataFrame, path: str, by: Sequence[str] = (), fmt: str = "parquet",
                 single_file: bool = False) -> None:
    """Write a report; with ``by`` only the periods present are replaced
    (dynamic partition overwrite), so re-running one month leaves the others."""
    df = report.coalesce(1) if single_file else report
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if by:
        w = w.partitionBy(*by)
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def display_view(report: DataFrame, by: Sequence[str] = (), rank_col: str | None = None,
                 decimals: int = 2, unmapped_label: str | None = None) -> DataFrame:
    """Report in display form, ordered: ``Total`` labels, ``emphasis``
    (``total`` for facility rows, ``grand`` for the grand row: the bold/green
    and yellow rows), numbers with fixed decimals and no thousands mark.

    ``report`` must be unlabeled (``labels=False``).  ``unmapped_label``
    optionally names the NULL (unmapped) facility.
    """
    ranked = order_report(report, by, rank_col=rank_col)
    kind = F.col("row_kind")
    emphasis = (F.when(kind == GRAND, F.lit("grand"))
                .when(kind == FACILITY, F.lit("total")).otherwise(F.lit("")))
    out = label_levels(ranked).withColumn("emphasis", emphasis)
    if unmapped_label is not None:
        out = out.withColumn("facility", F.coalesce("facility", F.lit(unmapped_label)))
    if "hours" in out.columns:
        out = out.withColumn("hours", F.format_string(f"%.{decimals}f", F.col("hours")))
    drop = [c for c in ("src_rank",) if c in out.columns]
    return out.drop(*drop).orderBy(*by, "report_rank")
