"""Hot keys, invariants on random inputs, typed reads, checkpoint folder."""

import os
import tempfile
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitetally.plans.hours import hours_report, nonexempt_report
from sitetally.plans.incidents import incident_report
from sitetally.session import checkpoint_dir, cut_lineage
from sitetally.sources.tables import read_table, rejected_cells

NEM = "cost_center string, facility string, section string"


def test_hot_key_holding_most_rows(spark):
    """One cost centre holds half of 400k rows; both join strategies give the
    exact totals (the hot key is combined map-side, never in one task)."""
    n = 400_000
    facts = (spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit("HOT"))
         .otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string"))).alias("cost_center"),
        F.lit("Regular").alias("wage_type"),
        (F.col("id") % 7).cast("decimal(18,2)").alias("hours")))
    m = spark.createDataFrame([("HOT", "F1", "S1")] + [(f"c{i}", "F2", f"S{i % 3}")
                                                      for i in range(1, 50, 2)], NEM)
    want_hot = sum(i % 7 for i in range(0, n, 2))
    want_all = sum(i % 7 for i in range(n))
    for rows in (200_000, 0):
        rep = nonexempt_report(facts, m, [], broadcast_rows=rows, labels=False)
        got = {(r.facility, r.section, r.row_kind): r.hours for r in rep.collect()}
        assert got[("F1", "S1", "section")] == float(want_hot)
        assert got[(None, None, "grand")] == float(want_all)


cells = st.sampled_from(["a", "b", "c", "d", None])
hours = st.one_of(st.none(), st.integers(min_value=0, max_value=30))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(ex=st.lists(st.tuples(cells, st.sampled_from(["p", "q"]), hours), max_size=25),
       ne=st.lists(st.tuples(cells, st.sampled_from(["W", "X"]), hours), max_size=25))
def test_report_invariants(spark, ex, ne):
    exm = spark.createDataFrame([("a", "p", "F1", "S1"), ("b", "p", "F1", "S2"),
                                 ("c", "q", "F2", "S1")],
                                "l4_org_unit string, personnel_area string, facility string, section string")
    nem = spark.createDataFrame([("a", "F1", "S1"), ("b", "F3", "S3")], NEM)
    exd = spark.createDataFrame([(a, b, None if h is None else Decimal(h)) for a, b, h in ex],
                                "l4_org_unit string, personnel_area string, hours decimal(18,2)")
    ned = spark.createDataFrame([(a, b, None if h is None else Decimal(h)) for a, b, h in ne],
                                "cost_center string, wage_type string, hours decimal(18,2)")
    rows = hours_report(exd, exm, ned, nem, ["X"], labels=False).collect()
    keys = [(r.facility, r.section, r.row_kind) for r in rows]
    assert len(keys) == len(set(keys))
    sections = [r for r in rows if r.row_kind == "section"]
    facilities = [r for r in rows if r.row_kind == "facility"]
    grand = [r for r in rows if r.row_kind == "grand"]
    assert len(grand) == 1
    assert abs(grand[0].hours - sum(r.hours for r in facilities)) < 1e-9
    for f in facilities:
        assert abs(f.hours - sum(s.hours for s in sections if s.facility == f.facility)) < 1e-9
    # every exempt mapping pair is present
    assert {("F1", "S1"), ("F1", "S2"), ("F2", "S1")} <= {(s.facility, s.section) for s in sections}


def test_incident_counts_add_up(spark):
    import datetime as dt
    lm = spark.createDataFrame([("L1", "F", "S"), ("L2", "F", "T")],
                               "location string, facility string, section string")
    inc = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, F.lit("L1")).when(F.col("id") % 3 == 1, F.lit("L2"))
         .otherwise(F.lit("ZZ")).alias("location"),
        F.lit(dt.date(2020, 1, 2)).alias("loss_date"),
        (F.col("id") % 4).cast("double").alias("lost_days"))
    g = incident_report(inc, lm, 2020, 1, labels=False).filter("row_kind = 'grand'").collect()[0]
    assert g.or_cases == 1000 and g.lt_cases == 750


def test_read_table_and_rejected_cells(spark):
    folder = tempfile.mkdtemp(prefix="sitetally-csv-")
    path = os.path.join(folder, "in.csv")
    with open(path, "w") as fh:
        fh.write("Cost Center,View Billable Hours [ST/Hr]\nA, 1.5\nB,x\nC,\n")
    df = read_table(spark, path, "`Cost Center` string, `View Billable Hours [ST/Hr]` string",
                    fmt="csv", header="true")
    assert df.columns == ["cost_center", "hours"]
    r = rejected_cells(df, {"hours": "double"}).collect()[0]
    assert r.hours_rejected == 1


def test_checkpoint_dir_is_read_from_the_session(spark):
    first = checkpoint_dir(spark)
    assert checkpoint_dir(spark) == first
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10
