"""Streaming reports on arrival, and the sinks."""

import os
import tempfile
from decimal import Decimal

from sitetally.plans.hours import nonexempt_report
from sitetally.sinks import display_view, write_report
from sitetally.streaming.uploads import report_on_arrival
from tests.fixtures import NONEXEMPT, frames

SCHEMA = "cost_center string, wage_type string, hours decimal(18,2), period string"


def _land(spark, landing, period, rows, mode="overwrite"):
    df = spark.createDataFrame([(a, b, None if h is None else Decimal(h)) for a, b, h in rows],
                               "cost_center string, wage_type string, hours decimal(18,2)")
    df.write.mode(mode).parquet(os.path.join(landing, f"period={period}"))


def test_reports_on_arrival_and_reupload(spark):
    base = tempfile.mkdtemp(prefix="sitetally-stream-")
    landing, out = os.path.join(base, "landing"), os.path.join(base, "out")
    ckpt = os.path.join(base, "ckpt")
    nem = frames(spark)["nonexempt_map"]

    def build(facts, by):
        return nonexempt_report(facts, nem, by=by)

    _land(spark, landing, "2019-11", NONEXEMPT)
    _land(spark, landing, "2019-12", [("Ashby CC Delv", "Regular", 5)])
    q = report_on_arrival(spark, landing, SCHEMA, build, out, checkpoint=ckpt, name="ne1")
    q.awaitTermination(120)
    res = spark.read.parquet(out)
    grand = {r.period: r.hours for r in res.filter("row_kind = 'grand'").collect()}
    assert grand == {"2019-11": 231.0, "2019-12": 5.0}

    # a corrected upload for December replaces only December
    _land(spark, landing, "2019-12", [("Ashby CC Delv", "Regular", 7)])
    q = report_on_arrival(spark, landing, SCHEMA, build, out, checkpoint=ckpt, name="ne2")
    q.awaitTermination(120)
    grand = {r.period: r.hours for r in spark.read.parquet(out).filter("row_kind = 'grand'").collect()}
    assert grand == {"2019-11": 231.0, "2019-12": 7.0}

    # a second file for November arrives later: November is recomputed whole
    _land(spark, landing, "2019-11", [("Ashby CC Delv", "Regular", 9)], mode="append")
    q = report_on_arrival(spark, landing, SCHEMA, build, out, checkpoint=ckpt, name="ne3")
    q.awaitTermination(120)
    grand = {r.period: r.hours for r in spark.read.parquet(out).filter("row_kind = 'grand'").collect()}
    assert grand == {"2019-11": 240.0, "2019-12": 7.0}


def test_display_view_and_csv(spark):
    f = frames(spark)
    rep = nonexempt_report(f["nonexempt"], f["nonexempt_map"], labels=False)
    view = display_view(rep, unmapped_label="(unmapped)")
    rows = [(r.facility, r.section, r.hours, r.emphasis) for r in view.collect()]
    assert rows[0] == ("Ashby", "Total", "150.00", "total")
    assert rows[-3] == ("Total", "Total", "231.00", "grand")
    assert rows[-1] == ("(unmapped)", None, "11.00", "")
    out = os.path.join(tempfile.mkdtemp(prefix="sitetally-csv-"), "r")
    write_report(view, out, fmt="csv", single_file=True)
    files = [p for p in os.listdir(out) if p.endswith(".csv")]
    assert len(files) == 1


def test_null_period_and_many_periods(spark, monkeypatch):
    from sitetally.streaming import uploads
    landed = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, "c")], "x int, period string")
    changed = spark.createDataFrame([(None,), ("a",)], "period string")
    for most in (1000, 1):
        monkeypatch.setattr(uploads, "MAX_LISTED_PERIODS", most)
        got = uploads._of_periods(landed, changed, ["period"])
        assert sorted(r.x for r in got.collect()) == [1, 2]
    two = changed.selectExpr("period", "'k' as other")
    got = uploads._of_periods(landed.selectExpr("*", "'k' as other"), two, ["period", "other"])
    assert sorted(r.x for r in got.collect()) == [1, 2]
