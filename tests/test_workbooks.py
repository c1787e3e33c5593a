"""Workbook ingest (S6) and sheet layouts, end to end on the golden example."""

import os
import tempfile

import pytest

from sitetally.plans.expenditures import expenditure_report
from sitetally.plans.hours import exempt_report, nonexempt_report
from sitetally.plans.incidents import incident_report
from sitetally.sources import layouts
from sitetally.sources.workbook import ingest_workbooks, sheet_rows
from tests import fixtures as fx
from tests.test_golden import EXPECTED
from tests.xlsx import write_xlsx


def _books(folder):
    exempt = [["L4 Org Unit Name", "Personnel Area Desc", "Total Hours"]]
    exempt += [[a, b, h] for a, b, h in fx.EXEMPT]
    nonexempt = [["Cost Center Desc.", "Wagetype Desc.", "Hours"]]
    nonexempt += [[a, b, h] for a, b, h in fx.NONEXEMPT]
    osha = [["Incident report", None, None], ["Florida", None, None], [None, "run", None],
            ["Location", "Loss Date", "Lost Work Days"]]
    osha += [[loc, float(s) if "." in s else int(s), None if d is None else int(d)]
             for loc, s, d in fx.INCIDENTS_RAW]
    expend = [["Billed hours export", None], ["Cost Center", "View Billable Hours [ST/Hr]"],
              ["CC1", 2.5], ["CC1", 1.5], ["CC2", 4], ["CC3", None],
              ["Total", 8], [None, None], ["Printed", "today"]]
    write_xlsx(os.path.join(folder, "exempt.xlsx"), {"Sheet1": exempt})
    write_xlsx(os.path.join(folder, "nonexempt.xlsx"), {"Details": nonexempt, "Other": [["x"]]})
    write_xlsx(os.path.join(folder, "osha.xlsx"), {"Data": osha})
    write_xlsx(os.path.join(folder, "expend.xlsx"), {"Billed": expend})


def test_sheet_rows_decoder():
    folder = tempfile.mkdtemp(prefix="sitetally-wb-")
    _books(folder)
    with open(os.path.join(folder, "osha.xlsx"), "rb") as fh:
        rows = list(sheet_rows(fh.read()))
    assert rows[0] == ("Data", 0, 0, ["Incident report"])
    assert rows[3] == ("Data", 0, 3, ["Location", "Loss Date", "Lost Work Days"])
    assert rows[-1][3] == ["ASHBY (HILL) - ES", "43790.5"]


def test_ingest_and_reports(spark):
    folder = tempfile.mkdtemp(prefix="sitetally-wb-")
    _books(folder)
    raw = ingest_workbooks(spark, folder)
    out = os.path.join(tempfile.mkdtemp(prefix="sitetally-raw-"), "raw")
    raw.write.mode("overwrite").parquet(out)
    rows = spark.read.parquet(out)
    f = fx.frames(spark)

    ex = exempt_report(layouts.exempt_hours(rows.filter(rows.path.endswith("exempt.xlsx")
                                                        & ~rows.path.endswith("nonexempt.xlsx"))),
                       f["exempt_map"])
    got = {(r.facility, r.section): r.hours for r in ex.collect()}
    assert got[("Ashby", "Total")] == 240.0 and got[("Total", "Total")] == 280.0

    ne = nonexempt_report(layouts.nonexempt_hours(rows), f["nonexempt_map"])
    got = {(r.facility, r.section): r.hours for r in ne.collect()}
    assert got[("Total", "Total")] == 231.0 and got[("Ashby", "Tool Care")] is None

    inc = incident_report(layouts.incidents(rows), f["location_map"], 2019, "November")
    got = {(r.facility, r.section): (r.or_cases, r.lt_cases) for r in inc.collect()}
    assert got[("Total", "Total")] == (5, 2)

    exp = expenditure_report(layouts.expenditures(rows.filter(rows.path.endswith("expend.xlsx"))))
    got = {r.cost_center: r.hours for r in exp.collect()}
    assert got == {"CC1": 4.0, "CC2": 4.0, "CC3": None}


def test_command_line_run(spark):
    import csv
    import glob
    from sitetally.__main__ import parser, run
    folder = tempfile.mkdtemp(prefix="sitetally-cli-")
    _books(folder)

    def write_csv(name, header, rows):
        path = os.path.join(folder, name)
        with open(path, "w", newline="", encoding="utf-8") as fh:
            w = csv.writer(fh)
            w.writerow(header)
            w.writerows(rows)
        return path

    em = write_csv("exempt_map.csv", ["L4 Org Unit Name", "Personnel Area Desc", "Facility", "Section"],
                   fx.EXEMPT_MAP)
    nm = write_csv("nonexempt_map.csv", ["Cost Center Desc.", "Facility", "Section"], fx.NONEXEMPT_MAP)
    lm = write_csv("location_map.csv", ["Location", "Facility", "Section"], fx.LOCATION_MAP)
    rules = write_csv("rules.csv", ["Column", "Value", "Message"],
                      [("location", "HEADQUARTERS - HQ", "recode HQ")])
    out = os.path.join(folder, "out")
    args = parser().parse_args([
        "--exempt", os.path.join(folder, "exempt.xlsx"),
        "--nonexempt", os.path.join(folder, "nonexempt.xlsx"),
        "--incidents", os.path.join(folder, "osha.xlsx"),
        "--exempt-map", em, "--nonexempt-map", nm, "--location-map", lm,
        "--alert-rules", rules, "--year", "2019", "--month", "November", "--out", out])
    written = run(spark, args)
    assert set(written) == {"hours", "incidents", "combined", "unmapped", "status", "alerts"}
    with open(glob.glob(os.path.join(written["combined"], "*.csv"))[0], encoding="utf-8") as fh:
        rows = list(csv.DictReader(fh))
    got = [(r["facility"], r["section"], r["hours"], r["or_cases"], r["lt_cases"]) for r in rows]
    want = [(f or "", s or "", "%.2f" % h, "" if o is None else str(o), "" if t is None else str(t))
            for f, s, _, h, o, t in EXPECTED]
    assert got == want
    with open(glob.glob(os.path.join(written["alerts"], "*.csv"))[0], encoding="utf-8") as fh:
        assert "HEADQUARTERS - HQ" in fh.read()


def test_half_a_period_is_refused_and_month_numbers_work(spark):
    from sitetally.__main__ import parser, run
    from sitetally.functions.dates import month_number
    args = parser().parse_args(["--exempt", "a", "--nonexempt", "b", "--incidents", "c", "--exempt-map", "d",
                                "--nonexempt-map", "e", "--location-map", "f", "--out", "o", "--month", "11"])
    with pytest.raises(ValueError, match="both --year and --month"):
        run(spark, args)
    assert month_number("11") == month_number("November") == 11


def _raw(spark, rows):
    return spark.createDataFrame(rows, "path string, sheet string, sheet_no int, row_index long, "
                                       "cells array<string>")


def test_repeated_headers_and_first_sheet(spark):
    from sitetally.sources.sheets import project_fields, promote_header, sheet_table
    raw = _raw(spark, [("p", "A", 0, 0, ["Location", "Notes", "Notes", ""]), ("p", "A", 0, 1, ["x", "1", "2"]),
                       ("p", "A", 0, 2, ["y"]), ("p", "B", 1, 0, ["Location", "Other"]),
                       ("p", "B", 1, 1, ["z", "9"])])
    cols = {"location": "Location", "notes": "Notes", "none": "Missing"}
    got = sorted(map(tuple, sheet_table(raw, cols, sheet=0).select("location", "notes", "none").collect()))
    assert got == [("x", "1", None), ("y", None, None)]
    steps = project_fields(promote_header(raw.where("sheet_no = 0")), cols)
    assert sorted(map(tuple, steps.select("location", "notes", "none").collect())) == got
    assert sheet_table(raw, {"location": "Location"}, sheet="B").count() == 1
    assert sheet_table(raw, {"location": "Location"}).count() == 3


def test_raw_rows_are_not_moved(spark):
    """The sheet index is the build side, and raw rows go through no exchange."""
    from sitetally.sources.sheets import sheet_table
    raw = _raw(spark, [("p", "A", 0, i, ["h" if i == 0 else str(i)]) for i in range(50)])
    for limit in (None, "1"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        try:
            if limit:
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            plan = sheet_table(raw, {"h": "h"})._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "BroadcastHashJoin" in plan and "BuildRight" in plan
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_index_written_at_ingest(spark):
    """Rows and sheet index from one decode give the tables that the row passes give, with one
    scan of the rows and no job while the plan is built."""
    from sitetally.sources.sheets import TOP_ROWS, sheet_table
    from sitetally.sources.workbook import land_workbooks, landed
    folder, out = tempfile.mkdtemp(prefix="sitetally-wb-"), tempfile.mkdtemp(prefix="sitetally-raw-")
    _books(folder)
    late = [[None, None]] * 2 + [["note", None]] + [[None, None]] * 40 + [["Location", "Count"], ["x", 1], ["y", 2]]
    write_xlsx(os.path.join(folder, "late.xlsx"), {"Data": late, "Blank": [[None]]})
    both = land_workbooks(spark, folder, os.path.join(out, "landed"))
    plain = ingest_workbooks(spark, folder)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(both.rows) == order(plain)
    assert both.index.groupBy("path", "sheet").count().where("count > 1").count() == 0
    assert both.index.where("sheet = 'Blank'").count() == 0
    columns = {"location": "Location", "count": "Count", "hours": "Hours", "missing": "Missing"}
    for skip, footer, sheet in [(0, 0, None), (3, 0, "Data"), (1, 3, 0), (2, 1, 1), (TOP_ROWS - 1, 0, None),
                                (TOP_ROWS, 1, None), (100, 0, None)]:
        assert order(sheet_table(both, columns, skip, footer, sheet)) == \
            order(sheet_table(plain, columns, skip, footer, sheet)), (skip, footer, sheet)
    from sitetally.sources import sheets
    refused, sheets._small = sheets._small, None        # any use while the plan is built fails
    try:
        plan = sheet_table(landed(spark, os.path.join(out, "landed")), columns, 3, 0, "Data")
    finally:
        sheets._small = refused
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 2 and text.count("= rows") == text.count("= index") == 1
    empty = tempfile.mkdtemp(prefix="sitetally-wb-")
    none = land_workbooks(spark, empty, os.path.join(out, "none"))
    assert none.rows.count() == none.index.count() == sheet_table(none, columns).count() == 0
