
import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sitetally.functions.dates import in_period, period_bounds, previous_period
from sitetally.functions.measures import hours_measure
from sitetally.operators.levels import join_reports, three_level
from sitetally.operators.mapping import (finish_states, section_states, unmapped_keys,
                                         validate_mapping)
from sitetally.plans.checks import coding_status, unmapped_report
from sitetally.plans.hours import (EXEMPT_KEYS, combined_hour_sections, exempt_report,
                                   hours_report, nonexempt_report)
from sitetally.plans.incidents import incident_report
from tests.fixtures import frames

EX = "l4_org_unit string, personnel_area string, hours decimal(18,2)"
NE = "cost_center string, wage_type string, hours decimal(18,2)"
EXM = "l4_org_unit string, personnel_area string, facility string, section string"
NEM = "cost_center string, facility string, section string"
INC = "location string, loss_date date, lost_days double"


def key(t):
    return tuple((x is None, x) for x in t)


def table(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)


def test_n1_report_join_matches_null_keys(spark):
    a = spark.createDataFrame([(None, None, "section", 1), ("F", None, "facility", 2)],
                              "facility string, section string, row_kind string, x int")
    b = spark.createDataFrame([(None, None, "section", 10), ("F", None, "facility", 20)],
                              "facility string, section string, row_kind string, y int")
    got = table(join_reports(a, b), "facility", "section", "row_kind", "x", "y")
    assert got == sorted([(None, None, "section", 1, 10), ("F", None, "facility", 2, 20)], key=key)
    plain = a.join(b, ["facility", "section", "row_kind"], "full")
    assert plain.count() == 4  # a plain equi join loses the NULL = NULL match


def test_n2_lenient_all_null_is_zero_and_strict_is_null(spark):
    m = spark.createDataFrame([("k", "F", "S")], NEM)
    facts = spark.createDataFrame([("k", "Regular", None), ("k", "Regular", None)], NE)
    for mode, want in (("lenient", 0), ("strict", None)):
        meas = hours_measure("hours", "hours", mode)
        st = finish_states(section_states(facts, m, ["cost_center"], [meas]), [meas])
        assert [r.hours for r in st.collect()] == [want]


def test_n3_null_wage_type_is_excluded(spark):
    m = spark.createDataFrame([("k", "F", "S")], NEM)
    facts = spark.createDataFrame([("k", None, Decimal(5)), ("k", "Regular", Decimal(7))], NE)
    rep = nonexempt_report(facts, m, ["3C Sick Pay"])
    assert table(rep.filter("row_kind = 'grand'"), "hours") == [(7.0,)]
    # no exclusion list: nothing is filtered, NULL wage type included
    rep = nonexempt_report(facts, m, [])
    assert table(rep.filter("row_kind = 'grand'"), "hours") == [(12.0,)]


def test_n6_real_sections_named_a_and_total_survive(spark):
    m = spark.createDataFrame([("k1", "F", "A"), ("k2", "F", "Total")], NEM)
    facts = spark.createDataFrame([("k1", "R", Decimal(1)), ("k2", "R", Decimal(2))], NE)
    got = table(nonexempt_report(facts, m, []), "facility", "section", "row_kind", "hours")
    assert got == sorted([("F", "A", "section", 1.0), ("F", "Total", "section", 2.0),
                          ("F", "Total", "facility", 3.0), ("Total", "Total", "grand", 3.0)],
                         key=key)


def test_n7_lost_days_compared_as_numbers(spark):
    lm = spark.createDataFrame([("L", "F", "S")], "location string, facility string, section string")
    d = dt.date(2019, 11, 5)
    raw = spark.createDataFrame([("L", d, "0.0"), ("L", d, "10"), ("L", d, "x"), ("L", d, None)],
                                "location string, loss_date date, lost_days string")
    rep = incident_report(raw, lm, 2019, 11)
    assert table(rep.filter("row_kind = 'section'"), "or_cases", "lt_cases") == [(4, 1)]


def test_n8_empty_inputs_keep_the_grand_row(spark):
    f = frames(spark)
    ex = exempt_report(spark.createDataFrame([], EX), f["exempt_map"])
    got = table(ex, "facility", "section", "row_kind", "hours")
    assert ("Total", "Total", "grand", None) in got
    assert len([g for g in got if g[2] == "section"]) == 4  # scaffold of every pair
    ne = nonexempt_report(spark.createDataFrame([], NE), f["nonexempt_map"])
    assert table(ne, "facility", "row_kind", "hours") == [("Total", "grand", None)]
    inc = incident_report(spark.createDataFrame([], INC), f["location_map"], 2019, 11)
    assert table(inc, "row_kind", "or_cases", "lt_cases") == [("grand", None, None)]
    hr = hours_report(spark.createDataFrame([], EX), f["exempt_map"],
                      spark.createDataFrame([], NE), f["nonexempt_map"])
    assert ("Total", "Total", "grand", 0.0) in table(hr, "facility", "section", "row_kind", "hours")


def test_n10_unmapped_report_schema_is_stable(spark):
    f = frames(spark)
    mapped_only = f["exempt"].filter("l4_org_unit != 'New Unit'")
    a = unmapped_report(f["exempt"], f["exempt_map"], EXEMPT_KEYS)
    b = unmapped_report(mapped_only, f["exempt_map"], EXEMPT_KEYS)
    assert a.schema == b.schema and b.count() == 0
    assert coding_status(b).collect()[0].unmapped_count == 0


def test_n12_incident_rows_cover_hours_rows(spark):
    f = frames(spark)
    from sitetally.sources.tables import typed_incidents
    inc = typed_incidents(f["incidents_raw"])
    hs = combined_hour_sections(f["exempt"], f["exempt_map"], f["nonexempt"], f["nonexempt_map"])
    hrs = hours_report(f["exempt"], f["exempt_map"], f["nonexempt"], f["nonexempt_map"])
    incr = incident_report(inc, f["location_map"], 2019, 11, hours_sections=hs)
    k = ["facility", "section", "row_kind"]
    assert hrs.select(*k).subtract(incr.select(*k)).count() == 0


def test_dates_and_periods():
    assert period_bounds(2019, "November") == (dt.date(2019, 11, 1), dt.date(2019, 12, 1))
    assert period_bounds(2019, 12) == (dt.date(2019, 12, 1), dt.date(2020, 1, 1))
    assert previous_period(dt.date(2020, 1, 15)) == (2019, "December")
    assert previous_period(dt.date(2020, 3, 31)) == (2020, "February")
    with pytest.raises(ValueError):
        period_bounds(2019, "Smarch")


def test_month_end_add_months(spark):
    got = spark.range(1).select(F.add_months(F.lit("2021-03-31").cast("date"), -1).alias("d"))
    assert got.collect()[0].d == dt.date(2021, 2, 28)


def test_in_period_on_dates(spark):
    df = spark.createDataFrame([(dt.date(2019, 10, 31),), (dt.date(2019, 11, 1),),
                                (dt.date(2019, 11, 30),), (dt.date(2019, 12, 1),)], "d date")
    assert df.filter(in_period("d", 2019, "November")).count() == 2


def test_validate_mapping_finds_blank_duplicate_and_drift(spark):
    m = spark.createDataFrame(
        [("", "Ashby", "Fleet"), ("", "Birchley", "Fleet"), ("a", "Ashby", "Tool Cares"),
         ("b", "Ashby", "Tool Care"), (None, "Oakdene", "Sales"), ("a", "Oakdene", "Sales")],
        NEM)
    issues = table(validate_mapping(m, ["cost_center"]), "issue", "key")
    assert ("blank_key", "") in issues
    assert ("null_key", "") in issues
    assert ("duplicate_key", "a") in issues and ("duplicate_key", "") in issues
    assert ("label_variant", None) in issues



def _random_hours(spark, seed, n=60):
    rnd = random.Random(seed)
    keys = ["k%d" % i for i in range(8)] + [None]
    ex = [(rnd.choice(keys), rnd.choice(["p1", "p2", None]),
           rnd.choice([None, Decimal(rnd.randint(0, 50))])) for _ in range(n)]
    exm = [("k%d" % i, p, "F%d" % (i % 3), "S%d" % (i % 4)) for i in range(6) for p in ("p1", "p2")]
    return (spark.createDataFrame(ex, EX), spark.createDataFrame(exm, EXM))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_r1_r2_broadcast_and_preaggregate_strategies_agree(spark, seed):
    ex, exm = _random_hours(spark, seed)
    meas = hours_measure("hours", "hours", "strict")
    a = finish_states(section_states(ex, exm, EXEMPT_KEYS, [meas], unmapped="keep"), [meas])
    b = finish_states(section_states(ex, exm, EXEMPT_KEYS, [meas], unmapped="keep",
                                     broadcast_rows=0), [meas])
    assert table(a, "facility", "section", "hours") == table(b, "facility", "section", "hours")
    # anti join == full join + is.na(facility) + unique + drop_na
    lit = (ex.join(exm, list(EXEMPT_KEYS), "full").filter(F.col("facility").isNull())
           .select(*EXEMPT_KEYS).distinct().dropna())
    anti = unmapped_keys(ex, exm, EXEMPT_KEYS)
    assert table(lit, *EXEMPT_KEYS) == table(anti, *EXEMPT_KEYS)


@pytest.mark.parametrize("seed", [4, 5])
def test_r3_three_level_equals_groupby_union(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["A", "B", None]), "S%d" % i, rnd.choice([None, rnd.randint(0, 9)]))
            for i in range(25)]
    sec = spark.createDataFrame(rows, "facility string, section string, h long")
    got = table(three_level(sec, ["h"]), "facility", "section", "row_kind", "h")
    fac = sec.groupBy("facility").agg(F.coalesce(F.sum("h"), F.lit(0)).alias("h"))
    want = [(f, s, "section", h) for f, s, h in rows]
    want += [(r.facility, None, "facility", r.h) for r in fac.collect()]
    want += [(None, None, "grand", sum(h for _, _, h in rows if h is not None))]
    assert got == sorted(want, key=key)


@pytest.mark.parametrize("seed", [6, 7])
def test_hours_union_equals_report_full_join(spark, seed):
    """The one-pass union form of the combined report equals the reference
    formulation: NULL-safe full join of the two finished reports, NULL -> 0,
    then x + y."""
    ex, exm = _random_hours(spark, seed)
    rnd = random.Random(seed)
    ne = spark.createDataFrame(
        [(rnd.choice(["c1", "c2", "c3", "zz", None]), rnd.choice(["R", "X"]),
          rnd.choice([None, Decimal(rnd.randint(0, 40))])) for _ in range(50)], NE)
    nem = spark.createDataFrame([("c1", "F0", "S0"), ("c2", "F1", "S9"), ("c3", "F7", "S1")], NEM)
    one = hours_report(ex, exm, ne, nem, ["X"], labels=False)
    a = nonexempt_report(ne, nem, ["X"], labels=False).withColumnRenamed("hours", "x")
    b = exempt_report(ex, exm, labels=False).withColumnRenamed("hours", "y")
    j = join_reports(a, b).select(
        "facility", "section", "row_kind",
        (F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))).alias("hours"))
    cols = ("facility", "section", "row_kind", "hours")
    assert table(one, *cols) == table(j, *cols)


def test_invariants_on_combined_report(spark):
    f = frames(spark)
    from sitetally.plans.incidents import combined_report
    from sitetally.sources.tables import typed_incidents
    inc = typed_incidents(f["incidents_raw"])
    rep = combined_report(f["exempt"], f["exempt_map"], f["nonexempt"], f["nonexempt_map"],
                          inc, f["location_map"], labels=False).cache()
    rows = rep.collect()
    fac = sum(r.hours or 0 for r in rows if r.row_kind == "facility")
    grand = [r for r in rows if r.row_kind == "grand"][0]
    assert grand.hours == fac
    # every incident of every period counted once (no period given, keep unmapped)
    assert grand.or_cases == inc.count()
    keys = [(r.facility, r.section, r.row_kind) for r in rows]
    assert len(keys) == len(set(keys))
    rep.unpersist()


def test_by_period_two_months(spark):
    lm = spark.createDataFrame([("L", "F", "S")], "location string, facility string, section string")
    raw = spark.createDataFrame(
        [("L", dt.date(2019, 11, 5), 1.0, 11), ("L", dt.date(2019, 12, 5), 0.0, 12),
         ("M", dt.date(2019, 12, 6), 2.0, 12)],
        "location string, loss_date date, lost_days double, m int")
    rep = incident_report(raw, lm, by=["m"])
    got = table(rep, "m", "facility", "section", "row_kind", "or_cases", "lt_cases")
    assert (11, "Total", "Total", "grand", 1, 1) in got
    assert (12, "Total", "Total", "grand", 2, 1) in got
    assert (12, None, None, "section", 1, 1) in got


def test_exempt_scaffold_by_period(spark):
    exm = spark.createDataFrame([("a", "p", "F", "S1"), ("b", "p", "F", "S2")], EXM)
    ex = spark.createDataFrame([("a", "p", Decimal(3), 1), ("a", "p", Decimal(4), 2)],
                               EX + ", yr int")
    rep = exempt_report(ex, exm, by=["yr"])
    got = table(rep.filter("row_kind = 'section'"), "yr", "section", "hours")
    assert got == [(1, "S1", 3.0), (1, "S2", None), (2, "S1", 4.0), (2, "S2", None)]


def test_v4_input_guard(spark):
    f = frames(spark)
    with pytest.raises(ValueError, match="lacks column"):
        nonexempt_report(f["exempt"], f["nonexempt_map"])


def test_label_drift_across_mappings(spark):
    from sitetally.operators.mapping import label_drift
    a = spark.createDataFrame([("k1", "Port Lark", "Sales"), ("k2", "Oakdene", "Sales"),
                               ("k3", "Ashby", "Fleet")], NEM)
    b = spark.createDataFrame([("k1", "South Dade", "Sales"), ("k2", "OAKDENE ", "Sales"),
                               ("k3", "Ashby", "Fleet")], NEM)
    got = {(r.label, r.sources, r.issue) for r in label_drift({"exempt": a, "incidents": b}).collect()}
    assert ("OAKDENE ", "incidents", "spelling") in got and ("Oakdene", "exempt", "spelling") in got
    assert ("Port Lark", "exempt", "missing") in got
    assert ("South Dade", "incidents", "missing") in got
    assert not any(lbl == "Ashby" for lbl, _, _ in got)


def test_key_spacing_variants_are_reported(spark):
    m = spark.createDataFrame([("OAKDENE - SALES", "Oakdene", "Sales"), ("OAKDENE- SALES", "Oakdene", "Sales"),
                               ("THORNBY - DIST", "Thornby", "Dispatch")], NEM)
    got = sorted(r.key for r in validate_mapping(m, ["cost_center"]).collect()
                 if r.issue == "key_variant")
    assert got == ["OAKDENE - SALES", "OAKDENE- SALES"]


def test_previous_period_column(spark):
    import datetime as dt
    from sitetally.functions.dates import previous_period_col
    got = spark.range(1).select(previous_period_col().alias("p"), F.current_date().alias("t")).collect()[0]
    first = got.t.replace(day=1)
    want = (first - dt.timedelta(days=1)).replace(day=1)
    assert got.p == want


def test_broadcast_check_bounds_rows_and_bytes(spark):
    from sitetally.operators.mapping import fits_broadcast
    m = spark.createDataFrame([("k%d" % i, "x" * 100) for i in range(50)], "k string, v string")
    assert fits_broadcast(m, max_rows=50, max_bytes=10_000)
    assert not fits_broadcast(m, max_rows=49, max_bytes=10_000)
    assert not fits_broadcast(m, max_rows=50, max_bytes=1_000)


def test_unmapped_keys_fallback_matches_broadcast(spark):
    f = frames(spark)
    a = unmapped_keys(f["exempt"], f["exempt_map"], EXEMPT_KEYS)
    b = unmapped_keys(f["exempt"], f["exempt_map"], EXEMPT_KEYS, broadcast_rows=0)
    assert table(a, *EXEMPT_KEYS) == table(b, *EXEMPT_KEYS) == [("New Unit", "Ashby, FL")]


def test_hours_are_not_rounded_before_the_sum(spark):
    from sitetally.functions.measures import sum_hours
    from sitetally.plans.expenditures import expenditure_report

    def total(values, dtype):
        df = spark.createDataFrame([("c", v) for v in values], f"cost_center string, hours {dtype}")
        return expenditure_report(df).first().hours

    assert total([0.333] * 3, "double") == 0.999
    assert total([0.125, 0.125], "double") == 0.25
    assert total([-0.125, 0.5], "double") == 0.375
    assert total([Decimal("9007199254740.01")] * 2, "decimal(18,2)") == 18014398509480.02
    # exact where a double is not
    df = spark.createDataFrame([(Decimal("900719925474.123456789"),)] * 3, "x decimal(28,9)")
    assert df.agg(sum_hours("x", df.schema["x"].dataType).alias("s")).first().s == Decimal("2702159776422.370370367")


def test_nan_and_infinity_are_no_hours(spark):
    from sitetally.functions.dates import serial_to_date
    from sitetally.functions.measures import sum_hours
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,), (None,)], "x double")
    assert float(df.agg(sum_hours("x").alias("s")).first().s) == 1.5
    t = spark.createDataFrame([("NaN",), ("43770",)], "d string")
    assert [r.d is None for r in t.select(serial_to_date("d").alias("d")).collect()] == [True, False]


def test_null_section_pair_is_shown_empty(spark):
    m = spark.createDataFrame([("u", "a", "F1", None), ("u", "b", "F1", "S1")], EXM)
    facts = spark.createDataFrame([("u", "a", Decimal(5)), ("u", "b", Decimal(1))], EX)
    from sitetally.plans.hours import exempt_report
    got = {(r.facility, r.section, r.row_kind): r.hours
           for r in exempt_report(facts, m, labels=False).collect()}
    assert got == {("F1", None, "section"): None, ("F1", "S1", "section"): 1.0,
                   ("F1", None, "facility"): 1.0, (None, None, "grand"): 1.0}


def test_blank_and_null_mapping_keys_match_nothing(spark):
    from sitetally.plans.hours import nonexempt_report
    m = spark.createDataFrame([("", "F", "S"), (" ", "F", "S"), (None, "F", "S"), (None, "F", "S"),
                               ("k", "F", "S")], NEM)
    facts = spark.createDataFrame([("k", "W", Decimal(1)), ("", "W", Decimal(2)), (None, "W", Decimal(4))], NE)
    for limit in (200_000, 0):
        got = {(r.facility, r.row_kind): r.hours for r in
               nonexempt_report(facts, m, [], labels=False, broadcast_rows=limit).collect()
               if r.row_kind == "facility"}
        assert got == {("F", "facility"): 1.0, (None, "facility"): 6.0}


def test_mapping_overwritten_in_place_is_checked_anew(spark, tmp_path):
    from sitetally.plans.hours import nonexempt_report
    path = str(tmp_path / "map.csv")

    def report(rows):
        with open(path, "w") as fh:
            fh.write("cost_center,facility,section\n" + "\n".join(rows) + "\n")
        m = spark.read.schema(NEM).csv(path, header=True)
        facts = spark.createDataFrame([("k", "W", Decimal(1))], NE)
        return [r.hours for r in nonexempt_report(facts, m, [], labels=False).collect()
                if r.row_kind == "grand"]

    assert report(["k,F,S"]) == [1.0]
    with pytest.raises(ValueError, match="several rows for key"):
        report(["k,F,S", "k,F,S"])
    assert report(["k,F,S"]) == [1.0]


def test_per_period_scaffold_at_any_mapping_size(spark):
    from sitetally.plans.hours import exempt_report
    big = spark.range(30_000).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("l4_org_unit"), F.lit("p").alias("personnel_area"),
        F.concat(F.lit("F"), (F.col("id") % 3).cast("string")).alias("facility"), F.lit("S").alias("section"))
    facts = spark.createDataFrame([("u1", "p", Decimal(1), 2001), ("u2", "p", Decimal(2), 2002)],
                                  EX + ", period int")
    want = None
    for limit in (200_000, 10_000, 0):
        got = sorted(map(tuple, exempt_report(facts, big, by=["period"], broadcast_rows=limit).collect()),
                     key=str)
        want = want or got
        assert got == want and len(got) == 2 * (3 + 3 + 1)


def test_edge_fixtures(spark):
    """FIXTURES.md edge list: all wage types excluded; en dash in a key; a
    key that differs only in spacing around its hyphen; malformed serials."""
    m = spark.createDataFrame([("Ops – North", "F", "S"), ("OAKDENE - SALES", "F", "T")], NEM)
    facts = spark.createDataFrame(
        [("Ops – North", "R", Decimal(2)), ("OAKDENE- SALES", "R", Decimal(3)),
         ("Ops – North", "3C Sick Pay", Decimal(5))], NE)
    rep = nonexempt_report(facts, m, ["3C Sick Pay"], labels=False)
    got = table(rep, "facility", "section", "row_kind", "hours")
    # the en dash key matches exactly; the respaced key does not (kept unmapped)
    assert ("F", "S", "section", 2.0) in got and (None, None, "section", 3.0) in got
    everything = nonexempt_report(facts, m, ["R", "3C Sick Pay"], labels=False)
    assert table(everything, "row_kind", "hours") == [("grand", None)]
    issues = {r.issue for r in validate_mapping(
        m.unionByName(spark.createDataFrame([("OAKDENE- SALES", "F", "T")], NEM)),
        ["cost_center"]).collect()}
    assert "key_variant" in issues
    from sitetally.sources.tables import typed_incidents
    lm = spark.createDataFrame([("L", "F", "S")], "location string, facility string, section string")
    raw = spark.createDataFrame([("L", "43770", "1"), ("L", "", "1"), ("L", "x", "1"),
                                 ("L", None, "1"), ("L", "43790.9", "0")],
                                "location string, loss_date_raw string, lost_days_raw string")
    inc = incident_report(typed_incidents(raw), lm, 2019, "November", labels=False)
    assert table(inc.filter("row_kind = 'grand'"), "or_cases", "lt_cases") == [(2, 1)]


def test_duplicate_mapping_keys_are_refused(spark):
    m = spark.createDataFrame([("k", "F", "S"), ("k", "G", "S")], NEM)
    facts = spark.createDataFrame([("k", "R", Decimal(1))], NE)
    with pytest.raises(ValueError, match="several rows for key"):
        nonexempt_report(facts, m, [])
