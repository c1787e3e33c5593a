"""Small literal tables (mappings, rule tables) as local relations.

A local relation has exact row count and size statistics for the optimizer, needs no
Python worker to scan it, can be broadcast or inlined, and is collected without a job.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def literal_table(spark: SparkSession, rows: Sequence[Sequence],
                  schema: T.StructType | str) -> DataFrame:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    fields = schema.fields
    if not rows:
        return spark.createDataFrame([], schema)
    for i, row in enumerate(rows):
        if len(row) != len(fields):
            raise ValueError(f"row {i} has {len(row)} values, expected {len(fields)}")
    columns = [pa.array(list(column)) for column in zip(*rows)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, [f.name for f in fields]), schema)
