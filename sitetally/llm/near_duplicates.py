"""Near duplicates by SuperMinHash: banding, exact verification, union-find.

A document is its set of distinct 3-word shingles (A-Z lower-cased, words between
ASCII white space; fewer words make one shingle of them all).  Two documents are
linked if 100 * intersection >= 85 * union; groups are the components of the links.

1. *Sets.*  Documents with equal sets become one set (a 128-bit hash), however many
   they are.  A set's signature has ``SLOTS`` = 320 SuperMinHash slots, kept as one
   byte each; 40 bands of 8 slots name its buckets.  Sets at 0.85 share a band with
   odds of 300,000 to 1, sets at 0.3 with odds of 1 to 400.
2. *Links* (``set_links``): pairs that the signatures hold near are compared on their
   full sets, first a few of each bucket of the first 8 bands, then those that still
   lie between groups in the buckets of all bands.  Buckets of more than ``SMALL`` sets
   are split by ``SPLIT_SLOTS`` more slots a level, ``SPLITS`` ways each.

Only links confirmed on full sets unite documents.  The components of all links
come from ``components`` (staged rounds), never from one task.

Defined cases: a NULL or empty text, or one of white space alone, has no shingles
and is its own group; a NULL id is in its group but never names it (a group of such
rows only has a NULL ``component_id``, and its rows are all kept); rows that repeat an
id are all kept where that id names the group; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, no_tables, read_table, staged
from .set_links import HEAVY_BYTES, SMALL, Rule, link_groups, zero_bytes
from .shingles import ascii_word_hashes, ascii_words_of_all, distinct, in_groups, shingle_hashes
from .superminhash import SLOTS, signatures

WIDTH = 3
PERCENT = 85
ROWS, BANDS, FIRST_BANDS = 8, SLOTS // 8, 8
MARGIN = 0.08                   # estimates of links lie lower than this with odds of about 1 to 30,000
SPLIT_SLOTS, SPLITS = 4, 6
GROUP_TEXTS, GROUP_BYTES = 2048, 4 << 20

DESCRIBED = "id long, t1 long, t2 long, s1 long, s2 long, size long, sketch binary"
_DESCRIBED = pa.schema([("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("s1", pa.int64()),
                        ("s2", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary())])


def shingle_set(data: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text."""
    if not data:
        return np.empty(0, np.uint64)
    return distinct(shingle_hashes(ascii_word_hashes(data), width))


def shingle_sets(data: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """``shingle_set`` of every text."""
    return [distinct(shingle_hashes(x, width)) for x in ascii_words_of_all(data)]


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_tables()
        for batch in batches:
            start = 0
            for texts in in_groups(batch.column("text").to_pylist(), GROUP_TEXTS, GROUP_BYTES):
                stop, sets = start + len(texts), shingle_sets(texts, width)
                some = [x for x in sets if len(x)]
                sketches = iter(signatures(some).astype(np.uint8)) if some else iter(())
                keys = [_set_key(x) if len(x) else (None, None) for x in sets]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(start, stop - start) for c in ("id", "t1", "t2")),
                    pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([next(sketches).tobytes() if len(x) else None for x in sets], pa.binary())],
                    schema=_DESCRIBED)
                start = stop
    return run


# ---- buckets -----------------------------------------------------------------

def _bucket(band, sketch="sketch"):
    """Bucket of a set in a band: a hash of the band's number and its slots."""
    at = band.cast("int") * F.lit(ROWS) + F.lit(1)
    return F.xxhash64(band, F.substring(F.col(sketch), at, F.lit(ROWS)))


def _in_buckets(sets: DataFrame, bands: int) -> DataFrame:
    """(s, band, node, group, size) for the first ``bands`` bands."""
    every = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    return sets.select("s", "group", "size", "sketch", every).select(
        "s", "band", _bucket(F.col("band")).alias("node"), "group", "size")


def prepared(rows: np.ndarray) -> np.ndarray:
    """Sketch rows as 64-bit words."""
    return np.ascontiguousarray(rows).view(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots of sketch rows (as they are, or ``prepared``), less what equal
    bytes make by chance."""
    if a.dtype == np.uint8:
        a, b = prepared(a), prepared(b)
    same = zero_bytes(a ^ b) / SLOTS
    return (same - 1 / 256) / (1 - 1 / 256)


def _first_bucket(frame: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs have no earlier band in common that is compared as a small bucket.

    ``bits`` marks a set's bands of that kind (0 in parts of split buckets)."""
    bits, band = frame["bits"].to_numpy().astype(np.uint64), frame["band"].to_numpy()
    both, out = bits[i] & bits[j], np.ones(len(i), dtype=bool)
    words = np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint64).reshape(len(frame), -1)
    for k in range(BANDS):
        earlier = (both >> np.uint64(k)) & np.uint64(1) == 1
        out &= ~(earlier & (k < band[i]) & (words[i, k] == words[j, k]))
    return out


def _split(sets: DataFrame):
    """Rows of large buckets in finer ones: ``SPLITS`` ways of ``SPLIT_SLOTS`` more equal slots."""
    def split(rows: DataFrame, depth: int) -> DataFrame:
        way = F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("way")
        rows = rows.hint("merge").join(sets.select("s", "sketch"), "s").select("s", "node", "band", "group", "size", "sketch", way)
        slots = [F.substring("sketch", F.pmod(F.xxhash64(F.col("band"), F.col("way"), F.lit(depth), F.lit(k)),
                                              F.lit(SLOTS)).cast("int") + 1, F.lit(1)) for k in range(SPLIT_SLOTS)]
        return rows.withColumn("node", F.xxhash64("node", "way", *slots)).drop("way", "sketch")
    return split


def group_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                          percent: int = PERCENT, small: int = SMALL, heavy: int = HEAVY_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept."""
    importable(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"),
                       F.col("text").cast("binary").alias("text"))
    described = staged(docs.mapInArrow(_describe(width), DESCRIBED), "near-described")
    sets = staged(described.where("s1 is not null").groupBy("s1", "s2").agg(
        F.min("id").alias("rep"), F.min(F.struct("t1", "t2")).alias("t"), F.first("size").alias("size"),
        F.first("sketch").alias("sketch")).select(
        "s1", "s2", "rep", "t.*", "size", "sketch", F.monotonically_increasing_id().alias("s")), "near-sets")
    rule = Rule(percent, percent / 100 - MARGIN, estimate, prepared, partial(shingle_sets, width=width), False, _first_bucket,
                small, heavy)
    first = _in_buckets(sets.withColumn("group", F.col("s")), FIRST_BANDS)
    tree = link_groups(docs.drop("id"), sets, first, lambda grouped: _in_buckets(grouped, BANDS), _split(sets), rule)
    named = sets.join(tree.withColumnRenamed("child", "s"), "s", "left").select(
        "s1", "s2", "rep", F.coalesce("parent", "s").alias("group"))
    smallest = named.groupBy("group").agg(F.min("rep").alias("least"))
    named = named.join(smallest, "group").select("s1", "s2", "least")
    rows = described.select("id", "s1", "s2", "size").join(named, ["s1", "s2"], "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
        F.when(F.col("s1").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return rows.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op11_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document, and whether it stands for it."""
    return group_near_duplicates(read_table(spark, sf_dir, "documents"))
