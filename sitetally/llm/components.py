"""Connected components by alternating star contraction, on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _state(pairs: DataFrame) -> tuple:
    """Count and order-free checksum of a pair table."""
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, name: str) -> DataFrame:
    """(child, parent) with the smallest node of its component for every other node.

    ``edges`` has columns ``child`` and ``parent``.  Each round writes a table of at
    most as many pairs as edges: every node is tied to the smallest node among its
    neighbours, first the larger ones (large star), then the smaller ones and
    itself (small star).  Rounds grow with the logarithm of the longest path.
    A hub's pairs are spread by the join's skew handling; minima are combined
    before the shuffle.
    """
    pairs = staged(edges.where("child != parent")
                        .select(F.greatest("child", "parent").alias("child"),
                                F.least("child", "parent").alias("parent")).distinct(), name)
    before = _state(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        low = both.groupBy("child").agg(F.least(F.min("parent"), F.col("child")).alias("low"))
        large = (both.join(low, "child").where("parent > child and parent != low")
                     .select(F.col("parent").alias("child"), F.col("low").alias("parent")).distinct())
        least = large.groupBy("child").agg(F.min("parent").alias("low"))
        small = large.join(least, "child")
        pairs = staged(small.select("child", F.col("low").alias("parent")).unionByName(
            small.where("parent != low").select(F.col("parent").alias("child"), F.col("low").alias("parent")))
            .distinct(), name)
        after = _state(pairs)
        if after == before:
            return pairs
        before = after
    return pairs
