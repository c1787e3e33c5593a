"""Shared folder, staged tables and hashing helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections import OrderedDict
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's source folder.

    Matters where the package is on a path that every node has but is not
    installed (a checkout); elsewhere the extra path entry finds nothing.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


# Tables that this worker process holds, least recently used first.  Workers are
# reused by stage after stage, so what an earlier one needed has to go.
_TABLES: OrderedDict = OrderedDict()
LIVE_TABLES = 2
M_MMAP_THRESHOLD = -3               # of glibc's malloc.h


def worker_table(key, make, alone: bool = False):
    """The worker's table for ``key``, made when it is not there.  The ``LIVE_TABLES`` used
    last are held, and only this one if its stage uses it ``alone``.  Each table bounds
    its own bytes; memory of those that go is given back to the system."""
    table = _TABLES.get(key)
    if table is None:
        while len(_TABLES) >= (1 if alone else LIVE_TABLES):
            _TABLES.popitem(last=False)
        _give_back()
        table = _TABLES[key] = make()
    _TABLES.move_to_end(key)
    return table


def no_tables() -> None:
    """Drop what earlier stages left in this worker, for a stage that needs no table."""
    if _TABLES:
        _TABLES.clear()
        _give_back()


def _give_back() -> None:
    """Return memory that this process no longer uses (glibc keeps it otherwise)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def large_arrays_apart() -> None:
    """Let this process map arrays of 4 MB and more one by one, so that each goes back to the
    system when it is dropped (glibc otherwise keeps those of up to 32 MB among the small)."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option:
        option(M_MMAP_THRESHOLD, 4 << 20)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage with a committed table: later stages re-read files when an
    executor is lost and never repeat the work before them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name in taken:
        n += 1
        name = f"__{stem}{n}"
    return name


def whole_text(col: str = "text"):
    """The text column with NULL read as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))
