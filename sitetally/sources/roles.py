"""The driver's TPC-H-like tables cast into the report roles.

* exempt hours: ``orders`` -- key (o_orderpriority, o_orderstatus), hours
  o_totalprice, period year(o_orderdate);
* non-exempt hours: ``lineitem`` joined to ``part`` -- cost centre p_brand,
  wage type l_returnflag, hours l_quantity (NULL for Brand#7 line 7, to
  exercise the strict sum), period year(l_shipdate);
* incidents: ``orders`` -- location priority-status, loss date o_orderdate,
  lost days o_custkey % 4;
* raw sheet rows: ``orders`` laid out as three text sheets with preamble,
  header and footer rows.

Mappings are configuration: small literal tables built here by rule.  The
same rows feed the DuckDB oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetally.sources.literal import literal_table
from sitetally.sources.sheets import SheetRows

# Fixed values for the test roles (invented labels).
FACILITIES = ("Ashby", "Birchley", "Oakdene", "Thornby")
SECTIONS = ("Dispatch", "Tool Care", "Fleet", "Sales", "Warehouse")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
STATUSES = ("F", "O", "P")

EXEMPT_MAP = (
    ("1-URGENT", "F", "Ashby", "Dispatch"),
    ("1-URGENT", "O", "Ashby", "Dispatch"),
    ("2-HIGH", "F", "Ashby", "Tool Care"),
    ("2-HIGH", "O", "Birchley", "Sales"),
    ("3-MEDIUM", "F", "Birchley", "Dispatch"),
    ("3-MEDIUM", "O", "Oakdene", "Dispatch"),
    ("4-NOT SPECIFIED", "F", "Oakdene", "Warehouse"),
    ("4-NOT SPECIFIED", "O", "Port Lark", "Sales"),
    ("0-NONE", "F", "Hillcrest", "Fleet"),
)

NO_SECTION_KEY = ("3-MEDIUM", "F")
BLANK_KEY_ROWS = (("", "Ashby", "Sales"), (" ", "Ashby", "Fleet"), (None, "Thornby", "Sales"),
                  (None, "Thornby", "Sales"))

EXCLUDED_FLAGS = ("R",)
NULL_HOURS_BRAND, NULL_HOURS_LINE = "Brand#7", 7
NULL_WAGE_FLAG, NULL_WAGE_LINE = "N", 3
PERIOD = (1999, "November")
ALERT_RULES = (
    ("location", "5-LOW-P", "Incidents at 5-LOW-P this month: recode them to a mapped location and reload."),
    ("location", "9-NONE-X", "Incidents at 9-NONE-X this month: retired location."),
    ("status", "P", "Incidents with status P this month: check that they are closed."),
)
SERIAL_ORIGIN_SQL = "1899-12-30"


def nonexempt_map_rows() -> list[tuple[str, str, str]]:
    """Brand#1..Brand#20 -> (facility n mod 4, section n mod 5); 21..25 unmapped."""
    return [(f"Brand#{n}", FACILITIES[n % 4], SECTIONS[n % 5]) for n in range(1, 21)]


def location_map_rows() -> list[tuple[str, str, str]]:
    """priority-status -> (facility by priority, section by priority+status);
    4-NOT SPECIFIED-P is an incident-only site, 5-LOW-* stays unmapped."""
    rows = []
    for i, prio in enumerate(PRIORITIES):
        for j, st in enumerate(STATUSES):
            rows.append((f"{prio}-{st}", FACILITIES[i], SECTIONS[(i + j) % 5]))
    rows[-1] = (rows[-1][0], "Pinemoor", "Fleet")
    return rows


# Declared input schemas (columns the roles use, as Spark reads the files):
# no schema inference at plan time, and only these columns are ever read.
TABLE_SCHEMAS = {
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
               "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
                 "l_returnflag string, l_shipdate timestamp_ntz"),
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def exempt_map(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, EXEMPT_MAP,
        "l4_org_unit string, personnel_area string, facility string, section string")


def nonexempt_map(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, nonexempt_map_rows(), "cost_center string, facility string, section string")


def location_map(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, location_map_rows(), "location string, facility string, section string")


def alert_rules(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ALERT_RULES, "column string, value string, message string")


def exempt_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("l4_org_unit"),
                    F.col("o_orderstatus").alias("personnel_area"),
                    F.col("o_totalprice").alias("hours"),
                    F.year("o_orderdate").alias("period_year"))


def nonexempt_facts(spark: SparkSession, sf_dir: str, null_wage: bool = False) -> DataFrame:
    """Line items with their part's brand.  Both sides grow with the scale
    factor, so this is a plain equi-join: Catalyst broadcasts ``part`` only
    while its statistics are under the broadcast threshold and otherwise
    plans a sort-merge join (AQE splits a skewed part key)."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey)
    null_hours = (F.col("p_brand") == NULL_HOURS_BRAND) & (F.col("l_linenumber") == NULL_HOURS_LINE)
    wage = F.col("l_returnflag")
    if null_wage:
        wage = F.when((F.col("l_returnflag") == NULL_WAGE_FLAG)
                      & (F.col("l_linenumber") == NULL_WAGE_LINE), F.lit(None)).otherwise(wage)
    return j.select(F.col("p_brand").alias("cost_center"),
                    wage.alias("wage_type"),
                    F.when(null_hours, F.lit(None)).otherwise(F.col("l_quantity")).alias("hours"),
                    F.year("l_shipdate").alias("period_year"))


def sub_cent_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' hours to a fraction of a cent: a third of the quantity and of the
    line number; NaN for a few lines, which counts as no value."""
    li = table(spark, sf_dir, "lineitem")
    third = F.col("l_quantity") / F.lit(3.0) + F.col("l_linenumber") / F.lit(7.0)
    nan = (F.col("l_orderkey") % 1009 == 0) & (F.col("l_returnflag") == "A")
    return li.select(F.concat_ws("-", "l_returnflag", F.col("l_linenumber").cast("string"))
                     .alias("cost_center"),
                     F.when(nan, F.lit(float("nan"))).otherwise(third).alias("hours"))


# Hours of any size: what a line item of each line number books (NULL: its quantity).
EXTREME_HOURS = ((1, (9e14,)), (2, (1e300, None, -1e300)), (3, (1e-12,)), (4, (-1e300, 0.25)),
                 (5, (1e17, None, -1e17, 5e-324)), (6, (0.1, 0.2, -0.3)), (7, (None,)))


def extreme_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings by line number, three to one a line item, sizes from 5e-324 to 1e300."""
    li = table(spark, sf_dir, "lineitem")
    booked = None
    for line, values in EXTREME_HOURS:
        row = F.array(*[F.col("l_quantity") if v is None else F.lit(v) for v in values])
        booked = (F.when(F.col("l_linenumber") == line, row) if booked is None
                  else booked.when(F.col("l_linenumber") == line, row))
    return li.select(F.col("l_linenumber").cast("string").alias("cost_center"),
                     F.explode(booked).alias("hours"))


def exempt_map_null_section(spark: SparkSession) -> DataFrame:
    rows = [(a, b, f, None if (a, b) == NO_SECTION_KEY else s) for a, b, f, s in EXEMPT_MAP]
    return literal_table(spark, rows, "l4_org_unit string, personnel_area string, "
                                      "facility string, section string")


def nonexempt_map_blank_keys(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [*nonexempt_map_rows(), *BLANK_KEY_ROWS],
                         "cost_center string, facility string, section string")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed incidents: ``location, status, loss_date (timestamp_ntz), lost_days``."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("location"),
                    F.col("o_orderstatus").alias("status"),
                    F.col("o_orderdate").alias("loss_date"),
                    (F.col("o_custkey") % 4).cast("double").alias("lost_days"),
                    F.year("o_orderdate").alias("period_year"),
                    F.month("o_orderdate").alias("period_month"))


def incidents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents as the sheet holds them: serial day numbers and lost days as
    text, with malformed cells ('x', '', fractional serials) mixed in."""
    o = table(spark, sf_dir, "orders")
    serial = F.datediff(F.col("o_orderdate").cast("date"),
                        F.lit(SERIAL_ORIGIN_SQL).cast("date")).cast("string")
    k = F.col("o_orderkey")
    raw = (F.when(k % 97 == 0, F.lit("x"))
           .when(k % 89 == 0, F.lit(""))
           .when(k % 83 == 0, F.concat(serial, F.lit(".5")))
           .when(k % 79 == 0, F.lit("NaN"))
           .otherwise(serial))
    return o.select("o_orderkey",
                    F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("location"),
                    raw.alias("loss_date_raw"),
                    F.when(k % 73 == 0, F.lit("NaN"))
                     .otherwise((F.col("o_custkey") % 4).cast("string")).alias("lost_days_raw"))


def part_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part catalogue read as a cost-centre mapping, with the defects a
    hand-kept mapping has: blank and NULL keys, duplicate keys, keys differing
    only in case or spacing, and label spelling variants."""
    p = table(spark, sf_dir, "part")
    key = (F.when(F.col("p_size") == 1, F.lit(""))
           .when(F.col("p_size") == 49, F.lit(None))
           .when(F.col("p_size") == 48, F.upper("p_name"))
           .when(F.col("p_size") == 47, F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")))
           .otherwise(F.col("p_name")))
    section = (F.when(F.col("p_size") == 50, F.concat(F.lower("p_type"), F.lit("s")))
               .otherwise(F.col("p_type")))
    return p.select(key.alias("cost_center"), F.col("p_brand").alias("facility"),
                    section.alias("section"))


SHEET_FILES = 3
PREAMBLE = (["Orders report", None, None], ["Generated by export", None, None])
FOOTER = (["", None, None], ["Rows above are orders", None, None], ["End of report", None, None])
HEADERS = (["Priority", "Status", "Customer"], ["Status", "Priority", "Customer"],
           ["Customer", "Priority", "Status"])


def _sheet_path():
    file_no = (F.col("o_orderkey") % SHEET_FILES).cast("int")
    return F.concat(F.lit("orders_"), file_no.cast("string"), F.lit(".xlsx"))


def _sheet_row():
    return (F.floor(F.col("o_orderkey") / SHEET_FILES) + 3).cast("long")


def _cells(xs):
    return F.array(*[F.lit(x).cast("string") for x in xs])


def _header_cells():
    return F.element_at(F.array(*[_cells(h) for h in HEADERS]), F.substring("path", 8, 1).cast("int") + 1)


def indexed_sheet_rows(spark: SparkSession, sf_dir: str) -> SheetRows:
    """``sheet_rows`` with the sheet index that an ingest writes; it has ``SHEET_FILES`` rows,
    so it may be broadcast."""
    files = table(spark, sf_dir, "orders").groupBy(_sheet_path().alias("path")).agg(
        F.max(_sheet_row()).alias("last"))
    top = lambda i, cells: F.struct(F.lit(i).cast("long").alias("row_index"), cells.alias("cells"))
    tops = [top(i, _cells(c)) for i, c in enumerate(PREAMBLE)]
    index = files.select("path", F.lit("Data").alias("sheet"), F.lit(0).alias("sheet_no"),
                         (F.col("last") + len(FOOTER)).alias("last"),
                         F.array(*tops, top(len(PREAMBLE), _header_cells())).alias("tops"))
    return SheetRows(sheet_rows(spark, sf_dir), F.broadcast(index))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as raw rows of three sheet files: ``path, sheet, row_index,
    cells array<string>``; two preamble rows, a header row whose column order
    differs per file, the data, three footer rows."""
    o = table(spark, sf_dir, "orders")
    file_no = (F.col("o_orderkey") % SHEET_FILES).cast("int")
    pr, st, cu = (F.col("o_orderpriority"), F.col("o_orderstatus"),
                  F.col("o_custkey").cast("string"))
    cells = (F.when(file_no == 0, F.array(pr, st, cu))
             .when(file_no == 1, F.array(st, pr, cu))
             .otherwise(F.array(cu, pr, st)))
    data = o.select(_sheet_path().alias("path"), F.lit("Data").alias("sheet"),
                    _sheet_row().alias("row_index"),
                    cells.alias("cells"))
    files = data.groupBy("path", "sheet").agg(F.max("row_index").alias("last"))
    fixed = [(i, _cells(c)) for i, c in enumerate(PREAMBLE)]
    top = [files.select("path", "sheet", F.lit(i).cast("long").alias("row_index"),
                        c.alias("cells")) for i, c in fixed]
    header = files.select("path", "sheet", F.lit(2).cast("long").alias("row_index"),
                          _header_cells().alias("cells"))
    foot = [files.select("path", "sheet", (F.col("last") + 1 + i).alias("row_index"),
                         _cells(c).alias("cells")) for i, c in enumerate(FOOTER)]
    out = data
    for part in top + [header] + foot:
        out = out.unionByName(part)
    return out
