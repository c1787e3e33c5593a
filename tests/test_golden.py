"""The worked example of FIXTURES.md section 3."""

from sitetally.functions.dates import serial_to_date
from sitetally.operators.levels import order_report
from sitetally.plans.checks import HQ_LOCATION, HQ_MESSAGE, coding_status, label_alerts, unmapped_report
from sitetally.plans.hours import (exempt_report, hours_report, nonexempt_report,
                                   combined_hour_sections, EXEMPT_KEYS)
from sitetally.plans.incidents import combined_report, incident_report
from sitetally.sources.tables import typed_incidents

from tests.fixtures import frames


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, x) for x in t))


def ordered(df, by=(), rank_col=None, cols=("facility", "section", "row_kind")):
    ranked = order_report(df, by, rank_col=rank_col)
    return [tuple(r[c] for c in cols) for r in ranked.orderBy("report_rank").collect()]


def test_exempt_report(spark):
    f = frames(spark)
    rep = exempt_report(f["exempt"], f["exempt_map"])
    assert rows(rep, "facility", "section", "row_kind", "hours") == sorted([
        ("Ashby", "Total", "facility", 240.0),
        ("Ashby", "Dispatch", "section", 160.0),
        ("Ashby", "Tool Care", "section", 80.0),
        ("Birchley", "Total", "facility", 40.0),
        ("Birchley", "Sales", "section", 40.0),
        ("Oakdene", "Total", "facility", None),
        ("Oakdene", "Dispatch", "section", None),
        ("Total", "Total", "grand", 280.0),
    ], key=lambda t: tuple((x is None, x) for x in t))


def test_nonexempt_report(spark):
    f = frames(spark)
    rep = nonexempt_report(f["nonexempt"], f["nonexempt_map"])
    got = rows(rep, "facility", "section", "row_kind", "hours")
    assert got == sorted([
        ("Ashby", "Total", "facility", 150.0),
        ("Ashby", "Dispatch", "section", 150.0),
        ("Ashby", "Tool Care", "section", None),
        ("Birchley", "Total", "facility", 70.0),
        ("Birchley", "Dispatch", "section", 70.0),
        ("Total", "Total", "grand", 231.0),
        (None, "Total", "facility", 11.0),
        (None, None, "section", 11.0),
    ], key=lambda t: tuple((x is None, x) for x in t))


EXPECTED = [
    ("Ashby", "Total", "facility", 390.0, 3, 1),
    ("Ashby", "Dispatch", "section", 310.0, 2, 1),
    ("Ashby", "Tool Care", "section", 80.0, 1, None),
    ("Birchley", "Total", "facility", 110.0, 1, None),
    ("Birchley", "Dispatch", "section", 70.0, None, None),
    ("Birchley", "Sales", "section", 40.0, 1, None),
    ("Oakdene", "Total", "facility", 0.0, None, None),
    ("Oakdene", "Dispatch", "section", 0.0, None, None),
    ("Total", "Total", "grand", 511.0, 5, 2),
    (None, "Total", "facility", 11.0, 1, 1),
    (None, None, "section", 11.0, 1, 1),
]


def test_hours_report_in_order(spark):
    f = frames(spark)
    rep = hours_report(f["exempt"], f["exempt_map"], f["nonexempt"], f["nonexempt_map"],
                       labels=False, keep_rank=True)
    from sitetally.operators.levels import label_levels
    ranked = label_levels(order_report(rep, rank_col="src_rank"))
    got = [(r.facility, r.section, r.row_kind, r.hours)
           for r in ranked.orderBy("report_rank").collect()]
    want = [e[:4] for e in EXPECTED]
    assert got == want


def test_combined_report_in_order(spark):
    f = frames(spark)
    inc = typed_incidents(f["incidents_raw"])
    rep = combined_report(f["exempt"], f["exempt_map"], f["nonexempt"], f["nonexempt_map"],
                          inc, f["location_map"], 2019, "November", labels=False,
                          keep_rank=True)
    from sitetally.operators.levels import label_levels
    ranked = label_levels(order_report(rep, rank_col="src_rank"))
    got = [(r.facility, r.section, r.row_kind, r.hours, r.or_cases, r.lt_cases)
           for r in ranked.orderBy("report_rank").collect()]
    assert got == EXPECTED


def test_incident_on_hours_layout(spark):
    f = frames(spark)
    inc = typed_incidents(f["incidents_raw"])
    hs = combined_hour_sections(f["exempt"], f["exempt_map"], f["nonexempt"], f["nonexempt_map"])
    rep = incident_report(inc, f["location_map"], 2019, 11, hours_sections=hs)
    got = rows(rep, "facility", "section", "row_kind", "or_cases", "lt_cases")
    want = sorted([(e[0], e[1], e[2], e[4], e[5]) for e in EXPECTED],
                  key=lambda t: tuple((x is None, x) for x in t))
    assert got == want


def test_incident_report_alone(spark):
    f = frames(spark)
    inc = typed_incidents(f["incidents_raw"])
    rep = incident_report(inc, f["location_map"], 2019, "November")
    got = rows(rep, "facility", "section", "row_kind", "or_cases", "lt_cases")
    assert got == sorted([
        ("Ashby", "Total", "facility", 3, 1),
        ("Ashby", "Dispatch", "section", 2, 1),
        ("Ashby", "Tool Care", "section", 1, None),
        ("Birchley", "Total", "facility", 1, None),
        ("Birchley", "Sales", "section", 1, None),
        ("Total", "Total", "grand", 5, 2),
        (None, "Total", "facility", 1, 1),
        (None, None, "section", 1, 1),
    ], key=lambda t: tuple((x is None, x) for x in t))


def test_unmapped_and_status(spark):
    f = frames(spark)
    um = unmapped_report(f["exempt"], f["exempt_map"], EXEMPT_KEYS)
    assert rows(um, "l4_org_unit", "personnel_area") == [("New Unit", "Ashby, FL")]
    st = coding_status(um).collect()
    assert st[0].unmapped_count == 1
    ok = coding_status(unmapped_report(f["exempt"].filter("l4_org_unit != 'New Unit'"),
                                       f["exempt_map"], EXEMPT_KEYS)).collect()
    assert ok[0].unmapped_count == 0 and ok[0].status.startswith("All locations")


def test_label_alert(spark):
    f = frames(spark)
    inc = typed_incidents(f["incidents_raw"])
    # the headquarters rule needs no rule table
    got = label_alerts(inc, None, 2019, "November").collect()
    assert [(r.value, r.message) for r in got] == [(HQ_LOCATION, HQ_MESSAGE)]
    assert label_alerts(inc, None, 2019, "December").count() == 0


def test_label_alerts_on_two_columns(spark):
    inc = spark.createDataFrame([("L1", "open"), ("L2", "closed"), (None, None)],
                                "location string, state string")
    rules = spark.createDataFrame(
        [("location", "L1", "m1"), ("state", "closed", "m2"), ("state", "L1", "never"),
         ("absent", "x", "never")], "column string, value string, message string")
    got = label_alerts(inc, rules).collect()
    assert sorted(r.message for r in got) == ["m1", "m2"]


def test_serial_dates(spark):
    df = spark.createDataFrame([("43770",), ("43790.5",), ("",), ("x",), (None,)], "s string")
    got = [r.d for r in df.select(serial_to_date("s").alias("d")).collect()]
    import datetime as dt
    assert got == [dt.date(2019, 11, 1), dt.date(2019, 11, 21), None, None, None]


def test_monthly_reports_share_one_hours_computation(spark):
    from sitetally.plans.monthly import monthly_reports
    f = frames(spark)
    inc = typed_incidents(f["incidents_raw"])
    m = monthly_reports(f["exempt"], f["exempt_map"], f["nonexempt"], f["nonexempt_map"],
                        inc, f["location_map"], 2019, "November")
    got = rows(m.combined, "facility", "section", "row_kind", "hours", "or_cases", "lt_cases")
    assert got == sorted(EXPECTED, key=lambda t: tuple((x is None, x) for x in t))
    hours = rows(m.hours, "facility", "section", "row_kind", "hours")
    assert hours == sorted([e[:4] for e in EXPECTED], key=lambda t: tuple((x is None, x) for x in t))
    inc_rows = rows(m.incidents, "facility", "section", "or_cases", "lt_cases")
    assert len(inc_rows) == len(EXPECTED)
    assert m.status.collect()[0].unmapped_count == 1
    assert m.alerts.count() == 1
    m.release()


def test_reports_match_declared_schemas(spark):
    from pyspark.sql import types as T
    from sitetally import schemas
    f = frames(spark)
    inc = typed_incidents(f["incidents_raw"])

    def same(df, ddl):
        want = T.StructType.fromDDL(ddl)
        return [(x.name, x.dataType) for x in df.schema.fields] == \
            [(x.name, x.dataType) for x in want.fields]
    assert same(hours_report(f["exempt"], f["exempt_map"], f["nonexempt"], f["nonexempt_map"]),
                schemas.HOURS_REPORT)
    assert same(incident_report(inc, f["location_map"], 2019, 11), schemas.INCIDENT_REPORT)
    assert same(combined_report(f["exempt"], f["exempt_map"], f["nonexempt"], f["nonexempt_map"],
                                inc, f["location_map"], 2019, 11), schemas.COMBINED_REPORT)
    um = unmapped_report(f["exempt"], f["exempt_map"], EXEMPT_KEYS)
    assert same(um, schemas.UNMAPPED_EXEMPT)
    assert same(coding_status(um), schemas.CODING_STATUS)
