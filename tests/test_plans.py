
import contextlib
import io

import pytest

from sitetally.catalog import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                "MapInPandas", "PythonUDF")


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_query_plans(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not any(n in text for n in PYTHON_NODES), name


@pytest.mark.parametrize("name", ["nonexempt_report", "exempt_report", "hours_report",
                                  "combined_report", "incident_report", "unmapped_keys"])
def test_mapping_is_broadcast_and_facts_never_full_outer(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "BroadcastHashJoin" in text
    assert "LocalTableScan" in text
    assert "FullOuter" not in text


def test_month_range_is_pushed_to_parquet(spark):
    text = plan(QUERIES["month_filter"](spark, SF))
    pushed = [ln for ln in text.splitlines() if "PushedFilters" in ln]
    assert pushed and "GreaterThanOrEqual(o_orderdate" in pushed[0] \
        and "LessThan(o_orderdate" in pushed[0]


def test_incident_report_prunes_and_pushes(spark):
    text = plan(QUERIES["incident_report"](spark, SF))
    schemas = [ln for ln in text.splitlines() if "ReadSchema" in ln]
    assert schemas and "o_totalprice" not in schemas[0]
    assert "GreaterThanOrEqual(o_orderdate" in text


def test_sheet_ops_use_no_window(spark):
    text = plan(QUERIES["sheet_header_footer"](spark, SF))
    assert "Window" not in text


def test_levels_come_from_one_expand_over_one_fact_scan(spark):
    df = QUERIES["nonexempt_report"](spark, SF)
    df.collect()
    text = plan(df, "simple").split("\n+- == Initial Plan ==")[0]
    assert text.count("Expand") == 1
    assert text.count("lineitem.parquet") == 1


@pytest.mark.parametrize("name", ["hours_report_by_period", "exempt_report_by_period",
                                  "combined_report_by_period"])
def test_per_period_reports_scan_each_fact_table_once(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    text = plan(df, "simple").split("\n+- == Initial Plan ==")[0]
    assert "orders.parquet" in text
    assert text.count("orders.parquet") <= (2 if name == "combined_report_by_period" else 1)
    assert text.count("lineitem.parquet") <= 1
