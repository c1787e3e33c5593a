"""The worked example of FIXTURES.md section 3 as DataFrames."""

from decimal import Decimal

from pyspark.sql import types as T

S = T.StringType()
H = T.DecimalType(18, 2)

EXEMPT_MAP = [
    ("Field Crew One", "Ashby, FL", "Ashby", "Dispatch"),
    ("Depot & Site Service", "Ashby, FL", "Ashby", "Tool Care"),
    ("Marketing", "Birchley, FL", "Birchley", "Sales"),
    ("Field Crew One", "Oakdene, FL", "Oakdene", "Dispatch"),
]
EXEMPT = [
    ("Field Crew One", "Ashby, FL", 160),
    ("Field Crew One", "Ashby, FL", None),
    ("Depot & Site Service", "Ashby, FL", 80),
    ("Marketing", "Birchley, FL", 40),
    ("New Unit", "Ashby, FL", 99),
    ("New Unit", "Ashby, FL", 1),
    (None, "Ashby, FL", 5),
    ("Field Crew One", "Oakdene, FL", 0),
]
NONEXEMPT_MAP = [
    ("Ashby CC Delv", "Ashby", "Dispatch"),
    ("Ashby CC Whse", "Ashby", "Dispatch"),
    ("Ashby CC Tool", "Ashby", "Tool Care"),
    ("Ashby CC Fleet", "Ashby", "Fleet"),
    ("PINEMOOR CC DELV", "Birchley", "Dispatch"),
]
NONEXEMPT = [
    ("Ashby CC Delv", "Regular", 100),
    ("Ashby CC Whse", "Regular", 50),
    ("Ashby CC Tool", "Overtime", None),
    ("Ashby CC Tool", "Regular", 30),
    ("PINEMOOR CC DELV", "Regular", 70),
    ("PINEMOOR CC DELV", "3C Sick Pay", 8),
    ("PINEMOOR CC DELV", None, 9),
    ("UNKNOWN CC", "Regular", 11),
]
LOCATION_MAP = [
    ("ASHBY (HILL) - DIST", "Ashby", "Dispatch"),
    ("ASHBY (HILL) - ES", "Ashby", "Tool Care"),
    ("BIRCHLEY - SALES", "Birchley", "Sales"),
]
INCIDENTS_RAW = [
    ("ASHBY (HILL) - DIST", "43770", "3"),
    ("ASHBY (HILL) - DIST", "43799", "0"),
    ("BIRCHLEY - SALES", "43780", "0"),
    ("HEADQUARTERS - HQ", "43785", "2"),
    ("BIRCHLEY - SALES", "43800", "4"),
    ("ASHBY (HILL) - ES", "43790.5", None),
]


def _dec(v):
    return None if v is None else Decimal(v)


def schema(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


def frames(spark):
    exempt_map = spark.createDataFrame(EXEMPT_MAP, schema(
        ("l4_org_unit", S), ("personnel_area", S), ("facility", S), ("section", S)))
    exempt = spark.createDataFrame([(a, b, _dec(h)) for a, b, h in EXEMPT], schema(
        ("l4_org_unit", S), ("personnel_area", S), ("hours", H)))
    nonexempt_map = spark.createDataFrame(NONEXEMPT_MAP, schema(
        ("cost_center", S), ("facility", S), ("section", S)))
    nonexempt = spark.createDataFrame([(a, b, _dec(h)) for a, b, h in NONEXEMPT], schema(
        ("cost_center", S), ("wage_type", S), ("hours", H)))
    location_map = spark.createDataFrame(LOCATION_MAP, schema(
        ("location", S), ("facility", S), ("section", S)))
    incidents_raw = spark.createDataFrame(INCIDENTS_RAW, schema(
        ("location", S), ("loss_date_raw", S), ("lost_days_raw", S)))
    return dict(exempt_map=exempt_map, exempt=exempt, nonexempt_map=nonexempt_map,
                nonexempt=nonexempt, location_map=location_map, incidents_raw=incidents_raw)
