"""Monthly reports from workbook and mapping files.

    python -m sitetally --exempt X --nonexempt Y --incidents Z \\
        --exempt-map a.csv --nonexempt-map b.csv --location-map c.csv \\
        [--year 2019 --month November] --out OUT

Workbook arguments are files or folders of ``.xlsx`` files; mapping files are
CSV with a header row (source or snake_case column names).  Without a period
the previous calendar month is reported.  Output folders under ``OUT``:
``hours``, ``incidents``, ``combined`` (single CSV files with the display
columns), ``unmapped``, ``status``, ``alerts`` and, with ``--expenditures``,
``expenditures``;
``_raw`` holds the decoded workbook rows and sheet indexes (Parquet), written once
and read by every report.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from sitetally import schemas
from sitetally.functions.dates import month_number, previous_period
from sitetally.plans.expenditures import expenditure_report
from sitetally.plans.monthly import monthly_reports
from sitetally.session import build_session
from sitetally.sinks import display_view, write_report
from sitetally.sources import layouts
from sitetally.sources.tables import blank_to_null, read_table
from sitetally.sources.workbook import land_workbooks

MAP_SCHEMAS = {
    "exempt": schemas.EXEMPT_MAP,
    "nonexempt": schemas.NONEXEMPT_MAP,
    "location": schemas.LOCATION_MAP,
    "rules": schemas.ALERT_RULES,
}


def read_mapping(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """CSV mapping with a header row; columns are taken by position."""
    df = read_table(spark, path, fmt="csv", header="true", encoding="UTF-8")
    names = [c.strip().split(" ")[0] for c in MAP_SCHEMAS[kind].split(",")]
    if len(df.columns) != len(names):
        raise ValueError(f"{path}: expected {len(names)} columns, found {df.columns}")
    return blank_to_null(df.toDF(*names))


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, str]:
    year, month = args.year, args.month
    if (year is None) != (month is None):
        raise ValueError("give both --year and --month, or neither for the previous month")
    if year is None:
        year, month = previous_period()
    month_number(month)
    raw = {}
    for k in ("exempt", "nonexempt", "incidents", *(["expenditures"] if args.expenditures else [])):
        # decode each workbook once; every report reads the written raw rows
        raw[k] = land_workbooks(spark, getattr(args, k), os.path.join(args.out, "_raw", k))
    m = monthly_reports(
        layouts.exempt_hours(raw["exempt"]), read_mapping(spark, args.exempt_map, "exempt"),
        layouts.nonexempt_hours(raw["nonexempt"]),
        read_mapping(spark, args.nonexempt_map, "nonexempt"),
        layouts.incidents(raw["incidents"]), read_mapping(spark, args.location_map, "location"),
        int(year), month,
        alert_rules=read_mapping(spark, args.alert_rules, "rules") if args.alert_rules else None,
        labels=False, keep_rank=True)
    out = {}
    try:
        for name, df, rank in (("hours", m.hours, "src_rank"), ("incidents", m.incidents, "src_rank"),
                               ("combined", m.combined, "src_rank")):
            path = os.path.join(args.out, name)
            view = display_view(df, rank_col=rank if rank in df.columns else None)
            write_report(view, path, fmt="csv", single_file=True)
            out[name] = path
        for name, df in (("unmapped", m.unmapped), ("status", m.status), ("alerts", m.alerts)):
            if df is not None:
                path = os.path.join(args.out, name)
                # unmapped keys come from the facts: their number has no bound, so no single file
                write_report(df, path, fmt="csv", single_file=name != "unmapped")
                out[name] = path
        if args.expenditures:
            path = os.path.join(args.out, "expenditures")
            write_report(expenditure_report(layouts.expenditures(raw["expenditures"])), path, fmt="csv")
            out["expenditures"] = path
    finally:
        m.release()
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sitetally", description=__doc__.split("\n\n")[0])
    for k in ("exempt", "nonexempt", "incidents"):
        p.add_argument(f"--{k}", required=True, help=f"{k} workbook file or folder")
    p.add_argument("--exempt-map", required=True)
    p.add_argument("--nonexempt-map", required=True)
    p.add_argument("--location-map", required=True)
    p.add_argument("--alert-rules", help="CSV: column,value,message (added to the built-in rule)")
    p.add_argument("--expenditures", help="expenditure workbook file or folder")
    p.add_argument("--year", type=int)
    p.add_argument("--month", help="month name or number")
    p.add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    for name, path in run(spark, args).items():
        print(f"{name}: {path}")


if __name__ == "__main__":
    main()
