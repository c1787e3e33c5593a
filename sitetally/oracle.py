"""DuckDB SQL equivalents of ``sitetally.catalog`` queries (the correctness
oracle).  Written independently as plain relational SQL: literal joins,
UNION ALL of the three levels, CROSS JOIN scaffolds, window rank.  Sums are
taken over DECIMAL(18,2) and cast to DOUBLE at the end.
"""

from __future__ import annotations

from sitetally.plans.checks import DEFAULT_RULES
from sitetally.sources import roles as R

YEAR = R.PERIOD[0]
MONTH_START, MONTH_END = "1999-11-01", "1999-12-01"


def _q(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _values(name: str, cols: tuple[str, ...], rows) -> str:
    body = ", ".join("(" + ", ".join(_q(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES {body})"


MAP_A = _values("map_a", ("l4_org_unit", "personnel_area", "facility", "section"), R.EXEMPT_MAP)
MAP_B = _values("map_b", ("cost_center", "facility", "section"), R.nonexempt_map_rows())
MAP_C = _values("map_c", ("location", "facility", "section"), R.location_map_rows())
RULES = _values("rules", ("col", "val", "message"), [*R.ALERT_RULES, *DEFAULT_RULES])
EXCL = ", ".join(_q(x) for x in R.EXCLUDED_FLAGS)

EX_FACTS = """ex_facts AS (
  SELECT o_orderpriority AS l4_org_unit, o_orderstatus AS personnel_area,
         o_totalprice AS hours, CAST(year(o_orderdate) AS INTEGER) AS period_year
  FROM orders)"""


def _ne_facts(null_wage: bool = False) -> str:
    wage = "l.l_returnflag"
    if null_wage:
        wage = (f"CASE WHEN l.l_returnflag = '{R.NULL_WAGE_FLAG}' AND l.l_linenumber = "
                f"{R.NULL_WAGE_LINE} THEN NULL ELSE l.l_returnflag END")
    return f"""ne_facts AS (
  SELECT p.p_brand AS cost_center, {wage} AS wage_type,
         CASE WHEN p.p_brand = '{R.NULL_HOURS_BRAND}' AND l.l_linenumber = {R.NULL_HOURS_LINE}
              THEN NULL ELSE l.l_quantity END AS hours,
         CAST(year(l.l_shipdate) AS INTEGER) AS period_year
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


NE_FACTS = _ne_facts()

INC = f"""inc AS (
  SELECT o_orderpriority || '-' || o_orderstatus AS location, o_orderstatus AS status,
         o_orderdate AS loss_date,
         CAST(o_custkey % 4 AS DOUBLE) AS lost_days,
         CAST(year(o_orderdate) AS INTEGER) AS period_year,
         CAST(month(o_orderdate) AS INTEGER) AS period_month
  FROM orders)"""

INC_PERIOD = f"""inc_p AS (
  SELECT * FROM inc
  WHERE loss_date >= TIMESTAMP '{MONTH_START}' AND loss_date < TIMESTAMP '{MONTH_END}')"""

SERIAL = "CAST(datediff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR)"
INC_TEXT = f"""inc_raw AS (
  SELECT o_orderkey, o_orderpriority || '-' || o_orderstatus AS location,
         CASE WHEN o_orderkey % 97 = 0 THEN 'x'
              WHEN o_orderkey % 89 = 0 THEN ''
              WHEN o_orderkey % 83 = 0 THEN {SERIAL} || '.5'
              WHEN o_orderkey % 79 = 0 THEN 'NaN'
              ELSE {SERIAL} END AS loss_date_raw,
         CASE WHEN o_orderkey % 73 = 0 THEN 'NaN' ELSE CAST(o_custkey % 4 AS VARCHAR) END AS lost_days_raw
  FROM orders),
inc_typed AS (
  SELECT o_orderkey, location,
         DATE '1899-12-30' + CAST(floor(TRY_CAST(NULLIF(NULLIF(trim(loss_date_raw), ''), 'NaN') AS DOUBLE)) AS INTEGER)
           AS loss_date,
         TRY_CAST(NULLIF(trim(lost_days_raw), '') AS DOUBLE) AS lost_days
  FROM inc_raw)"""

# Section CTEs -------------------------------------------------------------

NE_SEC = f"""ne_sec AS (
  SELECT m.facility, m.section,
         CASE WHEN count(*) = count(f.hours)
              THEN coalesce(sum(CAST(f.hours AS DECIMAL(18,2))), 0) END AS h
  FROM ne_facts f LEFT JOIN map_b m ON f.cost_center = m.cost_center
  WHERE f.wage_type NOT IN ({EXCL})
  GROUP BY m.facility, m.section)"""

EX_SEC = """ex_hit AS (
  SELECT m.facility, m.section, sum(CAST(f.hours AS DECIMAL(18,2))) AS h
  FROM ex_facts f JOIN map_a m
    ON f.l4_org_unit = m.l4_org_unit AND f.personnel_area = m.personnel_area
  GROUP BY m.facility, m.section),
ex_sec AS (
  SELECT g.facility, g.section, coalesce(x.h, 0) AS h
  FROM (SELECT DISTINCT facility, section FROM map_a) g
  LEFT JOIN ex_hit x ON g.facility = x.facility AND g.section = x.section)"""

HOURS_SEC = """hours_sec AS (
  SELECT facility, section, coalesce(sum(h), 0) AS h, min(src) AS src
  FROM (SELECT facility, section, h, 0 AS src FROM ne_sec
        UNION ALL SELECT facility, section, h, 1 AS src FROM ex_sec) u
  GROUP BY facility, section)"""


def _inc_sec(source: str) -> str:
    return f"""inc_sec AS (
  SELECT m.facility, m.section, count(*) AS or_cases,
         nullif(count(*) FILTER (WHERE i.lost_days > 0 AND NOT isnan(i.lost_days)), 0) AS lt_cases
  FROM {source} i LEFT JOIN map_c m ON i.location = m.location
  GROUP BY m.facility, m.section)"""


def _levels(sec: str, measures: dict[str, str]) -> str:
    """UNION ALL of section, facility and grand rows (unlabeled).

    ``measures``: column -> 'lenient' | 'sum'."""
    def fac(c, rule):
        return f"coalesce(sum({c}), 0) AS {c}" if rule == "lenient" else f"sum({c}) AS {c}"
    cols = ", ".join(measures)
    fac_cols = ", ".join(fac(c, r) for c, r in measures.items())
    grand_cols = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in measures)
    return f"""lv AS (
  SELECT facility, section, 'section' AS row_kind, {cols} FROM {sec}
  UNION ALL
  SELECT facility, NULL AS section, 'facility' AS row_kind, {fac_cols} FROM {sec} GROUP BY facility
  UNION ALL
  SELECT NULL AS facility, NULL AS section, 'grand' AS row_kind, {grand_cols} FROM {sec})"""


LABELS = """CASE WHEN row_kind = 'grand' THEN 'Total' ELSE facility END AS facility,
       CASE WHEN row_kind = 'section' THEN section ELSE 'Total' END AS section, row_kind"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def nonexempt_report() -> str:
    return _with(MAP_B, NE_FACTS, NE_SEC, _levels("ne_sec", {"h": "lenient"})) + f"""
SELECT {LABELS}, CAST(nullif(h, 0) AS DOUBLE) AS hours FROM lv"""


def nonexempt_sections_strict() -> str:
    return _with(MAP_B, NE_FACTS, NE_SEC) + """
SELECT facility, section, CAST(h AS DOUBLE) AS hours FROM ne_sec"""


def wage_exclusion_nulls() -> str:
    return _with(_ne_facts(null_wage=True)) + f"""
SELECT wage_type, count(*) AS kept_rows, CAST(sum(CAST(hours AS DECIMAL(18,2))) AS DOUBLE) AS hours
FROM ne_facts WHERE wage_type NOT IN ({EXCL}) GROUP BY wage_type"""


def exempt_sections_grid() -> str:
    return _with(MAP_A, EX_FACTS, EX_SEC) + """
SELECT facility, section, CAST(h AS DOUBLE) AS hours FROM ex_sec"""


def exempt_report() -> str:
    return _with(MAP_A, EX_FACTS, EX_SEC, _levels("ex_sec", {"h": "lenient"})) + f"""
SELECT {LABELS}, CAST(nullif(h, 0) AS DOUBLE) AS hours FROM lv"""


def _hours_ctes() -> list[str]:
    return [MAP_A, MAP_B, EX_FACTS, NE_FACTS, EX_SEC, NE_SEC, HOURS_SEC]


def hours_report() -> str:
    return _with(*_hours_ctes(), _levels("hours_sec", {"h": "lenient"})) + f"""
SELECT {LABELS}, CAST(h AS DOUBLE) AS hours FROM lv"""


def serial_dates() -> str:
    return _with(INC_TEXT) + """
SELECT o_orderkey, strftime(loss_date, '%Y-%m-%d') AS loss_date,
       strftime(loss_date, '%B') AS loss_month,
       CAST(year(loss_date) AS VARCHAR) AS loss_year
FROM inc_typed"""


def month_filter() -> str:
    return f"""SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '{MONTH_START}' AND o_orderdate < TIMESTAMP '{MONTH_END}'"""


def incident_sections() -> str:
    return _with(MAP_C, INC_TEXT, f"""inc_p AS (SELECT * FROM inc_typed
  WHERE loss_date >= DATE '{MONTH_START}' AND loss_date < DATE '{MONTH_END}')""",
                 _inc_sec("inc_p")) + """
SELECT facility, section, CAST(or_cases AS BIGINT) AS or_cases,
       CAST(lt_cases AS BIGINT) AS lt_cases FROM inc_sec"""


COUNT_COLS = """CAST(nullif(or_cases, 0) AS BIGINT) AS or_cases,
       CAST(nullif(lt_cases, 0) AS BIGINT) AS lt_cases"""


def incident_report() -> str:
    return _with(MAP_C, INC, INC_PERIOD, _inc_sec("inc_p"),
                 _levels("inc_sec", {"or_cases": "lenient", "lt_cases": "lenient"})) + f"""
SELECT {LABELS}, {COUNT_COLS} FROM lv"""


def incident_long() -> str:
    return _with(MAP_C, INC, INC_PERIOD, _inc_sec("inc_p")) + """
SELECT facility, section, 'or_cases' AS incident_type, CAST(or_cases AS BIGINT) AS cases FROM inc_sec
UNION ALL
SELECT facility, section, 'lt_cases' AS incident_type, CAST(lt_cases AS BIGINT) AS cases FROM inc_sec"""


def incident_wide() -> str:
    return _with(MAP_C, INC, INC_PERIOD, _inc_sec("inc_p")) + """
SELECT facility, CAST(coalesce(sum(or_cases), 0) AS BIGINT) AS or_cases,
       CAST(coalesce(sum(lt_cases), 0) AS BIGINT) AS lt_cases
FROM inc_sec GROUP BY facility"""


ALL_SEC = """all_sec AS (
  SELECT facility, section, sum(h) AS h, sum(or_cases) AS or_cases,
         sum(lt_cases) AS lt_cases, min(src) AS src
  FROM (SELECT facility, section, h, src, NULL AS or_cases, NULL AS lt_cases FROM hours_sec
        UNION ALL
        SELECT facility, section, NULL AS h, 2 AS src, or_cases, lt_cases FROM inc_sec) u
  GROUP BY facility, section)"""

ALL_RULES = {"h": "sum", "or_cases": "lenient", "lt_cases": "lenient"}


def incident_on_hours_layout() -> str:
    return _with(*_hours_ctes(), MAP_C, INC, INC_PERIOD, _inc_sec("inc_p"), ALL_SEC,
                 _levels("all_sec", ALL_RULES)) + f"""
SELECT {LABELS}, {COUNT_COLS} FROM lv"""


def combined_report() -> str:
    return _with(*_hours_ctes(), MAP_C, INC, INC_PERIOD, _inc_sec("inc_p"), ALL_SEC,
                 _levels("all_sec", ALL_RULES)) + f"""
SELECT {LABELS}, CAST(h AS DOUBLE) AS hours, {COUNT_COLS} FROM lv"""


UNMAPPED = """unmapped AS (
  SELECT DISTINCT 'New key: add it to the mapping' AS warning, f.l4_org_unit, f.personnel_area
  FROM ex_facts f
  WHERE f.l4_org_unit IS NOT NULL AND f.personnel_area IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM map_a m WHERE m.l4_org_unit = f.l4_org_unit
                                            AND m.personnel_area = f.personnel_area))"""


def unmapped_keys() -> str:
    return _with(MAP_A, EX_FACTS, UNMAPPED) + "SELECT * FROM unmapped"


def unmapped_status() -> str:
    return _with(MAP_A, EX_FACTS, UNMAPPED) + """
SELECT CAST(count(*) AS BIGINT) AS unmapped_count,
       CASE WHEN count(*) = 0 THEN 'All locations appear to be coded for'
            ELSE CAST(count(*) AS VARCHAR) || ' unmapped keys' END AS status
FROM unmapped"""


def label_alerts() -> str:
    return _with(RULES, INC, INC_PERIOD) + """
SELECT DISTINCT r.col AS "column", r.val AS "value", r.message FROM inc_p i JOIN rules r
  ON (r.col = 'location' AND i.location = r.val) OR (r.col = 'status' AND i.status = r.val)"""


def expenditure_by_center() -> str:
    return _with(NE_FACTS) + """
SELECT cost_center,
       CAST(CASE WHEN count(*) = count(hours)
                 THEN coalesce(sum(CAST(hours AS DECIMAL(18,2))), 0) END AS DOUBLE) AS hours
FROM ne_facts GROUP BY cost_center"""


def sub_cent_expenditures() -> str:
    # every value to nine decimals, NaN as no value
    return """
SELECT cost_center, round(CAST(CASE WHEN count(*) = count(h) THEN sum(h) END AS DOUBLE), 4) AS hours
FROM (SELECT l_returnflag || '-' || CAST(l_linenumber AS VARCHAR) AS cost_center,
             CASE WHEN l_orderkey % 1009 = 0 AND l_returnflag = 'A' THEN NULL
                  ELSE CAST(l_quantity / 3.0 + l_linenumber / 7.0 AS DECIMAL(28,9)) END AS h
      FROM lineitem)
GROUP BY cost_center"""


def expenditures_of_any_size() -> str:
    # each line's exact sum in closed form; a product of a count and a double is rounded once
    return """
SELECT CAST(l_linenumber AS VARCHAR) AS cost_center,
       CASE l_linenumber
         WHEN 1 THEN count(*) * CAST(9e14 AS DOUBLE)
         WHEN 2 THEN CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)
         WHEN 3 THEN count(*) * CAST(1e-12 AS DOUBLE)
         WHEN 4 THEN count(*) * CAST(-1e300 AS DOUBLE)
         WHEN 5 THEN CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)
         WHEN 6 THEN CAST(0 AS DOUBLE)
         ELSE CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) END AS hours
FROM lineitem GROUP BY l_linenumber"""


def exempt_report_null_section() -> str:
    rows = [(a, b, f, None if (a, b) == R.NO_SECTION_KEY else s) for a, b, f, s in R.EXEMPT_MAP]
    no_section = _values("map_a", ("l4_org_unit", "personnel_area", "facility", "section"), rows)
    return _with(no_section, EX_FACTS, EX_SEC, _levels("ex_sec", {"h": "lenient"})) + f"""
SELECT {LABELS}, CAST(nullif(h, 0) AS DOUBLE) AS hours FROM lv"""


def nonexempt_report_blank_keys() -> str:
    rows = [*R.nonexempt_map_rows(), *R.BLANK_KEY_ROWS]
    return _with(_values("map_b", ("cost_center", "facility", "section"), rows), NE_FACTS, NE_SEC,
                 _levels("ne_sec", {"h": "lenient"})) + f"""
SELECT {LABELS}, CAST(nullif(h, 0) AS DOUBLE) AS hours FROM lv"""


def sheet_header_footer() -> str:
    return """SELECT 'orders_' || CAST(o_orderkey % 3 AS VARCHAR) || '.xlsx' AS path,
       'Data' AS sheet, CAST(o_orderkey // 3 + 3 AS BIGINT) AS row_index,
       o_orderpriority AS priority, o_orderstatus AS status,
       CAST(o_custkey AS VARCHAR) AS customer
FROM orders"""


PART_MAP = """pm AS (
  SELECT CASE WHEN p_size = 1 THEN '' WHEN p_size = 49 THEN NULL
              WHEN p_size = 48 THEN upper(p_name) WHEN p_size = 47 THEN replace(p_name, ' ', '  ')
              ELSE p_name END AS cost_center,
         p_brand AS facility,
         CASE WHEN p_size = 50 THEN lower(p_type) || 's' ELSE p_type END AS section
  FROM part)"""


def _variants(label: str) -> str:
    fp = (f"regexp_replace(regexp_replace(lower(trim({label})), '[^0-9a-z]+', '', 'g'), "
          f"'s$', '')")
    return f"""
SELECT 'label_variant' AS issue, CAST(NULL AS VARCHAR) AS key, '{label}: ' || v.lbl AS detail
FROM (SELECT DISTINCT {fp} AS fp, {label} AS lbl FROM pm WHERE {label} IS NOT NULL) v
WHERE v.fp IN (SELECT {fp} FROM pm WHERE {label} IS NOT NULL
               GROUP BY 1 HAVING count(DISTINCT {label}) > 1)"""


def mapping_violations() -> str:
    return _with(PART_MAP) + f"""
SELECT 'null_key' AS issue, coalesce(cost_center, '') AS key, CAST(NULL AS VARCHAR) AS detail
FROM pm WHERE cost_center IS NULL
UNION ALL
SELECT 'blank_key', coalesce(cost_center, ''), CAST(NULL AS VARCHAR)
FROM pm WHERE trim(cost_center) = ''
UNION ALL
SELECT 'duplicate_key', coalesce(cost_center, ''), CAST(count(*) AS VARCHAR) || ' rows'
FROM pm GROUP BY cost_center HAVING count(*) > 1
UNION ALL
SELECT 'key_variant', v.k, v.fp
FROM (SELECT DISTINCT regexp_replace(lower(cost_center), '\\s+', '', 'g') AS fp, cost_center AS k
      FROM pm WHERE cost_center IS NOT NULL AND trim(cost_center) <> '') v
WHERE v.fp IN (SELECT regexp_replace(lower(cost_center), '\\s+', '', 'g') FROM pm
               WHERE cost_center IS NOT NULL AND trim(cost_center) <> ''
               GROUP BY 1 HAVING count(DISTINCT cost_center) > 1)
UNION ALL {_variants('facility')}
UNION ALL {_variants('section')}"""


def report_order() -> str:
    return _with(*_hours_ctes(), """lvs AS (
  SELECT facility, section, 'section' AS row_kind, h, src FROM hours_sec
  UNION ALL
  SELECT facility, NULL, 'facility', coalesce(sum(h), 0), min(src) FROM hours_sec GROUP BY facility
  UNION ALL
  SELECT NULL, NULL, 'grand', coalesce(sum(h), 0), 0 FROM hours_sec)""") + f"""
SELECT {LABELS}, CAST(h AS DOUBLE) AS hours,
       CAST(row_number() OVER (ORDER BY (facility IS NULL AND row_kind <> 'grand'),
                                        (row_kind = 'grand'), facility NULLS LAST, src,
                                        (row_kind = 'section'), section NULLS LAST) AS INTEGER)
         AS report_rank
FROM lvs"""


def hours_report_by_period() -> str:
    return _with(MAP_A, MAP_B, EX_FACTS, NE_FACTS, f"""ne_sec AS (
  SELECT f.period_year, m.facility, m.section,
         CASE WHEN count(*) = count(f.hours)
              THEN coalesce(sum(CAST(f.hours AS DECIMAL(18,2))), 0) END AS h
  FROM ne_facts f LEFT JOIN map_b m ON f.cost_center = m.cost_center
  WHERE f.wage_type NOT IN ({EXCL})
  GROUP BY f.period_year, m.facility, m.section)""", """ex_all AS (
  SELECT f.period_year, m.facility, m.section, sum(CAST(f.hours AS DECIMAL(18,2))) AS h
  FROM ex_facts f LEFT JOIN map_a m
    ON f.l4_org_unit = m.l4_org_unit AND f.personnel_area = m.personnel_area
  GROUP BY f.period_year, m.facility, m.section)""", """periods AS (
  SELECT period_year FROM ex_all UNION SELECT period_year FROM ne_sec)""", """ex_sec AS (
  SELECT p.period_year, g.facility, g.section, coalesce(x.h, 0) AS h
  FROM periods p CROSS JOIN (SELECT DISTINCT facility, section FROM map_a) g
  LEFT JOIN ex_all x ON x.period_year = p.period_year AND x.facility = g.facility
                    AND x.section = g.section)""", """hs AS (
  SELECT period_year, facility, section, coalesce(sum(h), 0) AS h
  FROM (SELECT period_year, facility, section, h FROM ne_sec
        UNION ALL SELECT period_year, facility, section, h FROM ex_sec) u
  GROUP BY period_year, facility, section)""", """lv AS (
  SELECT period_year, facility, section, 'section' AS row_kind, h FROM hs
  UNION ALL
  SELECT period_year, facility, NULL, 'facility', coalesce(sum(h), 0) FROM hs
  GROUP BY period_year, facility
  UNION ALL
  SELECT period_year, NULL, NULL, 'grand', coalesce(sum(h), 0) FROM hs GROUP BY period_year)""") + f"""
SELECT period_year, {LABELS}, CAST(h AS DOUBLE) AS hours FROM lv"""


def incident_report_by_period() -> str:
    return _with(MAP_C, INC, """inc_sec AS (
  SELECT i.period_year, i.period_month, m.facility, m.section, count(*) AS or_cases,
         nullif(count(*) FILTER (WHERE i.lost_days > 0 AND NOT isnan(i.lost_days)), 0) AS lt_cases
  FROM inc i LEFT JOIN map_c m ON i.location = m.location
  GROUP BY i.period_year, i.period_month, m.facility, m.section)""", """lv AS (
  SELECT period_year, period_month, facility, section, 'section' AS row_kind, or_cases, lt_cases
  FROM inc_sec
  UNION ALL
  SELECT period_year, period_month, facility, NULL, 'facility',
         coalesce(sum(or_cases), 0), coalesce(sum(lt_cases), 0)
  FROM inc_sec GROUP BY period_year, period_month, facility
  UNION ALL
  SELECT period_year, period_month, NULL, NULL, 'grand',
         coalesce(sum(or_cases), 0), coalesce(sum(lt_cases), 0)
  FROM inc_sec GROUP BY period_year, period_month)""") + f"""
SELECT period_year, period_month, {LABELS}, {COUNT_COLS} FROM lv"""


def exempt_report_by_period() -> str:
    return _with(MAP_A, EX_FACTS, """ex_all AS (
  SELECT f.period_year, m.facility, m.section, sum(CAST(f.hours AS DECIMAL(18,2))) AS h
  FROM ex_facts f LEFT JOIN map_a m
    ON f.l4_org_unit = m.l4_org_unit AND f.personnel_area = m.personnel_area
  GROUP BY f.period_year, m.facility, m.section)""", """ex_sec AS (
  SELECT p.period_year, g.facility, g.section, coalesce(x.h, 0) AS h
  FROM (SELECT DISTINCT period_year FROM ex_all) p
  CROSS JOIN (SELECT DISTINCT facility, section FROM map_a) g
  LEFT JOIN ex_all x ON x.period_year = p.period_year AND x.facility = g.facility
                    AND x.section = g.section)""", """lv AS (
  SELECT period_year, facility, section, 'section' AS row_kind, h FROM ex_sec
  UNION ALL
  SELECT period_year, facility, NULL, 'facility', coalesce(sum(h), 0) FROM ex_sec
  GROUP BY period_year, facility
  UNION ALL
  SELECT period_year, NULL, NULL, 'grand', coalesce(sum(h), 0) FROM ex_sec GROUP BY period_year)""") + f"""
SELECT period_year, {LABELS}, CAST(nullif(h, 0) AS DOUBLE) AS hours FROM lv"""


def rejected_cells() -> str:
    return _with(INC_TEXT) + """
SELECT CAST(count(*) FILTER (WHERE NULLIF(trim(r.loss_date_raw), '') IS NOT NULL
                               AND t.loss_date IS NULL) AS BIGINT) AS loss_date_raw_rejected,
       CAST(count(*) FILTER (WHERE NULLIF(trim(r.lost_days_raw), '') IS NOT NULL
                               AND t.lost_days IS NULL) AS BIGINT) AS lost_days_raw_rejected
FROM inc_raw r JOIN inc_typed t ON r.o_orderkey = t.o_orderkey"""


def hours_display() -> str:
    return _with(*_hours_ctes(), """lvs AS (
  SELECT facility, section, 'section' AS row_kind, h, src FROM hours_sec
  UNION ALL
  SELECT facility, NULL, 'facility', coalesce(sum(h), 0), min(src) FROM hours_sec GROUP BY facility
  UNION ALL
  SELECT NULL, NULL, 'grand', coalesce(sum(h), 0), 0 FROM hours_sec)""") + f"""
SELECT {LABELS}, printf('%.2f', CAST(h AS DOUBLE)) AS hours,
       CAST(row_number() OVER (ORDER BY (facility IS NULL AND row_kind <> 'grand'),
                                        (row_kind = 'grand'), facility NULLS LAST, src,
                                        (row_kind = 'section'), section NULLS LAST) AS INTEGER)
         AS report_rank,
       CASE row_kind WHEN 'grand' THEN 'grand' WHEN 'facility' THEN 'total' ELSE '' END AS emphasis
FROM lvs"""


def _levels_by(sec: str, measures: dict[str, str], by: str) -> str:
    """``_levels`` with a leading period column."""
    def fac(c, rule):
        return f"coalesce(sum({c}), 0) AS {c}" if rule == "lenient" else f"sum({c}) AS {c}"
    cols = ", ".join(measures)
    fac_cols = ", ".join(fac(c, r) for c, r in measures.items())
    grand_cols = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in measures)
    return f"""lv AS (
  SELECT {by}, facility, section, 'section' AS row_kind, {cols} FROM {sec}
  UNION ALL
  SELECT {by}, facility, NULL AS section, 'facility' AS row_kind, {fac_cols} FROM {sec}
  GROUP BY {by}, facility
  UNION ALL
  SELECT {by}, NULL AS facility, NULL AS section, 'grand' AS row_kind, {grand_cols} FROM {sec}
  GROUP BY {by})"""


def combined_report_by_period() -> str:
    return _with(MAP_A, MAP_B, MAP_C, EX_FACTS, NE_FACTS, INC, f"""ne_sec AS (
  SELECT f.period_year, m.facility, m.section,
         CASE WHEN count(*) = count(f.hours)
              THEN coalesce(sum(CAST(f.hours AS DECIMAL(18,2))), 0) END AS h
  FROM ne_facts f LEFT JOIN map_b m ON f.cost_center = m.cost_center
  WHERE f.wage_type NOT IN ({EXCL})
  GROUP BY f.period_year, m.facility, m.section)""", """ex_all AS (
  SELECT f.period_year, m.facility, m.section, sum(CAST(f.hours AS DECIMAL(18,2))) AS h
  FROM ex_facts f LEFT JOIN map_a m
    ON f.l4_org_unit = m.l4_org_unit AND f.personnel_area = m.personnel_area
  GROUP BY f.period_year, m.facility, m.section)""", """periods AS (
  SELECT period_year FROM ex_all UNION SELECT period_year FROM ne_sec)""", """ex_sec AS (
  SELECT p.period_year, g.facility, g.section, coalesce(x.h, 0) AS h
  FROM periods p CROSS JOIN (SELECT DISTINCT facility, section FROM map_a) g
  LEFT JOIN ex_all x ON x.period_year = p.period_year AND x.facility = g.facility
                    AND x.section = g.section)""", """hours_sec AS (
  SELECT period_year, facility, section, coalesce(sum(h), 0) AS h, min(src) AS src
  FROM (SELECT period_year, facility, section, h, 0 AS src FROM ne_sec
        UNION ALL SELECT period_year, facility, section, h, 1 AS src FROM ex_sec) u
  GROUP BY period_year, facility, section)""", """inc_sec AS (
  SELECT i.period_year, m.facility, m.section, count(*) AS or_cases,
         nullif(count(*) FILTER (WHERE i.lost_days > 0 AND NOT isnan(i.lost_days)), 0) AS lt_cases
  FROM inc i LEFT JOIN map_c m ON i.location = m.location
  GROUP BY i.period_year, m.facility, m.section)""", """all_sec AS (
  SELECT period_year, facility, section, sum(h) AS h, sum(or_cases) AS or_cases,
         sum(lt_cases) AS lt_cases
  FROM (SELECT period_year, facility, section, h, NULL AS or_cases, NULL AS lt_cases
        FROM hours_sec
        UNION ALL
        SELECT period_year, facility, section, NULL AS h, or_cases, lt_cases FROM inc_sec) u
  GROUP BY period_year, facility, section)""", _levels_by("all_sec", ALL_RULES, "period_year")) + f"""
SELECT period_year, {LABELS}, CAST(h AS DOUBLE) AS hours, {COUNT_COLS} FROM lv"""


SQL = {
    "nonexempt_report": nonexempt_report(),
    "nonexempt_sections_strict": nonexempt_sections_strict(),
    "wage_exclusion_nulls": wage_exclusion_nulls(),
    "exempt_sections_grid": exempt_sections_grid(),
    "exempt_report": exempt_report(),
    "hours_report": hours_report(),
    "serial_dates": serial_dates(),
    "month_filter": month_filter(),
    "incident_sections": incident_sections(),
    "incident_report": incident_report(),
    "incident_long": incident_long(),
    "incident_wide": incident_wide(),
    "incident_on_hours_layout": incident_on_hours_layout(),
    "combined_report": combined_report(),
    "unmapped_keys": unmapped_keys(),
    "unmapped_status": unmapped_status(),
    "label_alerts": label_alerts(),
    "expenditure_by_center": expenditure_by_center(),
    "sub_cent_expenditures": sub_cent_expenditures(),
    "expenditures_of_any_size": expenditures_of_any_size(),
    "exempt_report_null_section": exempt_report_null_section(),
    "exempt_report_by_period_joined": exempt_report_by_period(),
    "nonexempt_report_blank_keys": nonexempt_report_blank_keys(),
    "sheet_header_footer": sheet_header_footer(),
    "sheet_header_footer_steps": sheet_header_footer(),
    "mapping_violations": mapping_violations(),
    "report_order": report_order(),
    "hours_report_by_period": hours_report_by_period(),
    "incident_report_by_period": incident_report_by_period(),
    "nonexempt_report_preaggregated": nonexempt_report(),
    "exempt_report_by_period": exempt_report_by_period(),
    "rejected_cells": rejected_cells(),
    "hours_display": hours_display(),
    "combined_report_by_period": combined_report_by_period(),
}
