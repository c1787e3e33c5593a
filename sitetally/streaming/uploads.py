"""Reports as uploads land.

The reference recomputes its reports whenever a new monthly file is
uploaded.  The streaming form watches a landing folder of fact files laid
out by period (``<landing>/<period col>=<value>/...``).  A micro-batch only
says *which* periods changed: each of them is recomputed from the whole
landing table (a filter on the period column, which reads just those period
folders), and just those period partitions of the output are overwritten.  So an upload split over
several files or batches still gives a complete report, and a corrected
re-upload (the period folder overwritten by files of new names, as every Spark
write does) replaces its period.  Spark's file source knows files by path: a file
changed under its old name starts no batch, so corrections come under new names.

Recovery: the stream's offsets live in a checkpoint folder under the
cluster's shared ``spark.checkpoint.dir``; a replayed batch rewrites the
same partitions from the same files, so the sink is idempotent.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sitetally.session import checkpoint_dir
from sitetally.sinks import write_report


MAX_LISTED_PERIODS = 1000


def _of_periods(landed: DataFrame, changed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of ``landed`` whose period is among ``changed``; a NULL period is a period.

    Up to ``MAX_LISTED_PERIODS`` periods become a static filter that prunes the
    folders to read; more (a first run over a long landing folder) are joined and
    never brought to the driver.  Both give the same rows.
    """
    few = changed.limit(MAX_LISTED_PERIODS + 1).collect()
    if len(few) > MAX_LISTED_PERIODS:
        listed = changed.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(by)])
        cond = [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(by)]
        return landed.join(listed, reduce(Column.__and__, cond), "left_semi")
    if len(by) == 1:
        values = [r[0] for r in few if r[0] is not None]
        cond = F.col(by[0]).isin(values) if values else F.lit(False)
        if len(values) < len(few):
            cond = cond | F.col(by[0]).isNull()
        return landed.filter(cond)
    terms = [reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(x)) for c, x in zip(by, r)]) for r in few]
    return landed.filter(reduce(Column.__or__, terms, F.lit(False)))


def report_on_arrival(spark: SparkSession, landing: str, schema: T.StructType | str,
                      build_report: Callable[[DataFrame, Sequence[str]], DataFrame],
                      out: str, by: Sequence[str] = ("period",), name: str = "report",
                      checkpoint: str | None = None, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Start the stream; ``build_report(facts, by)`` builds one report over a
    batch of facts.  ``available_now`` processes what has landed and stops
    (a scheduled run); otherwise the query keeps watching the folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    facts = reader.load(landing)
    by = list(by)

    def handle(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select(*by).distinct()
        if batch.isEmpty():
            return
        landed = spark.read.schema(schema).format(fmt).load(landing)
        write_report(build_report(_of_periods(landed, changed, by), by), out, by)

    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), f"stream-{name}")
    w = facts.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.queryName(name).start()
