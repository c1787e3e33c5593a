import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sitetally.functions.measures import hours_measure
from sitetally.operators.levels import three_level
from sitetally.operators.mapping import fact_states, finish_states, merge_states
from sitetally.plans.expenditures import expenditure_report
from sitetally.plans.hours import hours_report, nonexempt_report


def totals(spark, groups, partitions=5):
    rows = [(str(k), v) for k, vs in groups.items() for v in vs]
    random.Random(len(rows) + partitions).shuffle(rows)
    df = spark.createDataFrame(rows, "cost_center string, hours double").repartition(partitions)
    return {r.cost_center: r.hours for r in expenditure_report(df).collect()}


def test_sums_equal_the_exact_sum_rounded_once(spark):
    rng = random.Random(1)
    groups = {
        "cancel": [1e300, 1e-12, -1e300] + [9e14] * 12,
        "any size": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(300)],
        "smallest": [5e-324] * 7 + [-5e-324],
        "largest": [1.7e308, -1.7e308, 2.2e-308, 3e-310],
        "zero": [0.0, -0.0],
        "thirds": [1 / 3] * 100,
        "powers": [2.0 ** 32, 2.0 ** -32, -1.0, 2.0 ** 64],
        "every power": [(-1) ** i * 2.0 ** i for i in range(-1074, 1023)],
        "half way": [2.0 ** 53, 1.0, 2.0 ** -60],
        "negative": [-0.1] * 7 + [1e17, -1e17],
        "twelve": [9e14] * 12,
    }
    groups |= {f"random {k}": [rng.gauss(0, 1) * 2.0 ** rng.randint(-60, 60) for _ in range(rng.randint(1, 40))]
               for k in range(20)}
    got = totals(spark, groups)
    want = {k: math.fsum(vs) for k, vs in groups.items()}
    assert got == want
    assert totals(spark, groups, 1) == got                # whatever the order and the partitions
    assert totals(spark, {"over": [1.7e308] * 2})["over"] == math.inf


def test_decimals_written_as_doubles_add_up_as_decimals(spark):
    rng = random.Random(2)
    groups = {k: [round(rng.uniform(-10.0 ** k, 10.0 ** k), 2) for _ in range(2000)] for k in range(6)}
    got = totals(spark, groups)
    assert got == {str(k): float(sum(Decimal(repr(v)) for v in vs)) for k, vs in groups.items()}
    assert totals(spark, {"a": [0.1, 0.2, -0.3], "b": [0.1] * 10, "c": [0.333] * 3}) == {"a": 0.0, "b": 1.0, "c": 0.999}


@pytest.mark.parametrize("mode", ["lenient", "strict"])
def test_states_merge_in_any_way(spark, mode):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.choice([None, 1e200, -1e200, 0.25, 1e-200, float("nan")])) for _ in range(400)]
    df = spark.createDataFrame(rows, "facility string, hours double").withColumn("section", F.lit("s"))
    m = hours_measure("hours", "hours", mode)
    whole = finish_states(fact_states(df, ["facility", "section"], [m]), [m])
    parts = None
    for k in range(4):
        part = fact_states(df.filter(F.pmod(F.hash("hours"), F.lit(4)) == k), ["facility", "section"], [m])
        parts = part if parts is None else parts.unionByName(part)
    again = finish_states(merge_states(merge_states(parts, [m]), [m]), [m])
    assert sorted(whole.collect()) == sorted(again.collect())
    if mode == "lenient":
        assert {r.facility: r.hours for r in whole.collect()} == {f: math.fsum(
            v for g, v in rows if g == f and v is not None and v == v) for f in "xy"}
    else:
        assert [r.hours for r in whole.collect()] == [None, None]


def test_totals_of_section_values_are_exact_too(spark):
    rows = [("F", f"s{i}", v) for i, v in enumerate([1e300, 0.25, -1e300, None, 1e-3])] + [("G", "s", None)]
    sections = spark.createDataFrame(rows, "facility string, section string, hours double")
    got = {(r.facility, r.section, r.row_kind): r.hours for r in three_level(sections, ["hours"]).collect()}
    assert got[("F", None, "facility")] == 0.251 and got[(None, None, "grand")] == 0.251
    assert got[("G", None, "facility")] == 0.0 and got[("F", "s3", "section")] is None
    rolled = {r.row_kind: r.hours for r in three_level(sections.filter("facility = 'G'"), {"hours": "sum"}).collect()}
    assert rolled == {"section": None, "facility": None, "grand": 0.0}


def test_reports_take_hours_of_any_size(spark):
    facts = spark.createDataFrame([("k", "R", 9e14)] * 12 + [("k", "R", 1e16), ("m", "R", 1e300), ("m", "R", -1e300),
                                                            ("m", "R", 1e-12)], "cost_center string, wage_type string, hours double")
    mapping = spark.createDataFrame([("k", "F", "A"), ("m", "F", "B")], "cost_center string, facility string, section string")
    got = {(r.section, r.row_kind): r.hours for r in nonexempt_report(facts, mapping, []).collect()}
    assert got == {("A", "section"): 2.08e16, ("B", "section"): 1e-12, ("Total", "facility"): 2.08e16,
                   ("Total", "grand"): 2.08e16}
    exempt = spark.createDataFrame([("u", "p", 0.1), ("u", "p", 1e200)], "l4_org_unit string, personnel_area string, hours double")
    emap = spark.createDataFrame([("u", "p", "F", "B")], "l4_org_unit string, personnel_area string, facility string, section string")
    both = {(r.section, r.row_kind): r.hours for r in hours_report(exempt, emap, facts, mapping, []).collect()}
    assert both[("B", "section")] == 1e200 and both[("Total", "grand")] == 1e200


def test_decimal_hours_beyond_a_long(spark):
    df = spark.createDataFrame([("c", Decimal("9000000000000000000.5"))] * 12, "cost_center string, hours decimal(28,9)")
    assert expenditure_report(df).first().hours == 1.08e20
