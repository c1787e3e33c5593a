"""Token-ID files of directly addressable codes (DAC).

An id is cut into 8-bit chunks, low chunk first.  Level 0 holds the low chunk of
every id; a continuation bitmap marks the ids that have a chunk on the next
level, and a rank directory (ones before each block of ``RANK_BITS`` bits) maps
a position on one level to its position on the next.  Any id is thus read from
one byte per level, without decoding its neighbours.

Storage: a Parquet dataset of segments in ascending ``doc_id`` order.  Spark's
committer keeps exactly one attempt of each task, so lost executors leave no
half-written or doubled segment.  ``part`` orders the write tasks, ``seg`` the
segments of a task and ``first_token`` counts the task's ids before a segment.
A document is never split over segments; a segment is closed once it holds
``segment_tokens`` ids.

Defined cases: a NULL or empty text has only the end id; rows with one
``doc_id`` (or a NULL one, which sorts first) each keep their own entry, in
order of their text's hash; an empty table gives no segments; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import importable, new_folder, read_table
from .tokens import default_vocabulary, encoder

CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 18

SEGMENT_SCHEMA = ("part int, seg int, first_token long, n_tokens long, doc_ids array<string>, "
                  "doc_tokens array<long>, levels array<binary>, bitmaps array<binary>, "
                  "ranks array<binary>")


def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of non-negative ids."""
    levels, bitmaps, ranks = [], [], []
    rest = np.asarray(ids, dtype=np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> CHUNK_BITS
        more = rest != 0
        if not more.any():
            return levels, bitmaps, ranks
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32)
        before = np.concatenate(([0], np.cumsum(per_block)[:-1])).astype("<u4")
        bitmaps.append(bits.tobytes())
        ranks.append(before.tobytes())
        rest = rest[more]


class DacView:
    """Random access to the ids of one segment."""

    def __init__(self, levels, bitmaps, ranks):
        self.levels = [np.frombuffer(x, dtype=np.uint8) for x in levels]
        self.bitmaps = [np.frombuffer(x, dtype=np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, dtype="<u4") for x in ranks]

    def _rank(self, level: int, pos: int) -> int:
        """Ones before ``pos`` in a level's bitmap: directory entry plus one block's rest."""
        if pos == 0:
            return 0
        block = min(pos // RANK_BITS, len(self.ranks[level]) - 1)
        start = block * RANK_BITS
        bits = np.unpackbits(self.bitmaps[level][start // 8:(pos + 7) // 8], bitorder="little")
        return int(self.ranks[level][block]) + int(bits[:pos - start].sum())

    def at(self, pos: int) -> int:
        """The id at ``pos``: one chunk, bit and rank per level."""
        value = 0
        for level, chunks in enumerate(self.levels):
            value |= int(chunks[pos]) << (CHUNK_BITS * level)
            if level == len(self.bitmaps) or not (self.bitmaps[level][pos >> 3] >> (pos & 7)) & 1:
                return value
            pos = self._rank(level, pos)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start:stop`` as uint32; touches only those chunks on every level."""
        out = self.levels[0][start:stop].astype(np.uint32)
        where = np.arange(stop - start)
        a, b = start, stop
        for level in range(len(self.bitmaps)):
            if a == b:
                break
            bits = np.unpackbits(self.bitmaps[level][a >> 3:(b + 7) >> 3], bitorder="little")
            more = bits[a & 7:(a & 7) + b - a].astype(bool)
            first = self._rank(level, a)
            where = where[more]
            a, b = first, first + len(where)
            out[where] |= self.levels[level + 1][a:b].astype(np.uint32) << (CHUNK_BITS * (level + 1))
        return out


def _write_segments(vocabulary: str, end_id: int, segment_tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        seg = first = held = 0
        doc_ids, lengths, blobs = [], [], []

        def close():
            levels, bitmaps, ranks = dac_encode(np.frombuffer(b"".join(blobs), dtype=enc.dtype))
            return pd.DataFrame({
                "part": [part], "seg": [seg], "first_token": [first], "n_tokens": [held],
                "doc_ids": [doc_ids], "doc_tokens": [lengths], "levels": [levels],
                "bitmaps": [bitmaps], "ranks": [ranks]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                blob = enc.encode(text) + end
                doc_ids.append(doc_id)
                lengths.append(len(blob) // enc.dtype.itemsize)
                blobs.append(blob)
                held += lengths[-1]
                if held >= segment_tokens:
                    yield close()
                    seg, first, held = seg + 1, first + held, 0
                    doc_ids, lengths, blobs = [], [], []
        if doc_ids:
            yield close()
    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text",
                      segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every document and write the segments below ``path``."""
    importable(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
         .repartitionByRange("doc_id", F.xxhash64("text"))
         .sortWithinPartitions("doc_id", F.xxhash64("text"))
         .select(F.col("doc_id").cast("string"), "text")
         .mapInPandas(_write_segments(vocabulary, end_id, segment_tokens), SEGMENT_SCHEMA)
         .write.parquet(path))


def with_starts(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``: ids of all documents before the segment.

    One total per write task is summed up in order; those totals number as many
    as the tasks of the write, so that frame is broadcast.
    """
    importable(spark)
    segs = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = segs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (segs.join(F.broadcast(bases), "part")
                .withColumn("start", F.col("base") + F.col("first_token")))


def _read_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            view = DacView(row.levels, row.bitmaps, row.ranks)
            stops = np.cumsum(np.asarray(row.doc_tokens, dtype=np.int64))
            starts = stops - np.asarray(row.doc_tokens, dtype=np.int64)
            ids = memoryview(view.slice(0, int(stops[-1])).astype("<u4").tobytes())
            crcs = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
            yield pd.DataFrame({"doc_id": pd.array([None if x is None else int(x) for x in row.doc_ids],
                                                   dtype="Int64"),
                                "start": starts + row.start, "n_tokens": stops - starts,
                                "ids_crc32": np.array(crcs, dtype=np.int64)})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    return with_starts(spark, path).select(
        "start", "doc_ids", "doc_tokens", "levels", "bitmaps", "ranks").mapInPandas(
        _read_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            view = DacView(row.levels, row.bitmaps, row.ranks)
            yield pd.DataFrame({"position": row.positions,
                                "token_id": [view.at(int(p) - row.start) for p in row.positions]})


def read_tokens(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """Ids at global positions (column ``position``), by random access.

    The segment of a position is found by a join on its 2**18-id bucket.
    """
    segs = with_starts(spark, path)
    span = SEGMENT_TOKENS
    keyed = segs.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("n_tokens") - 1) / span))))
    asked = positions.select("position", F.floor(F.col("position") / span).alias("bucket"))
    hits = (asked.join(keyed.select("bucket", "part", "seg", "start", "n_tokens"), "bucket")
                 .where("position >= start and position < start + n_tokens")
                 .groupBy("part", "seg").agg(F.collect_list("position").alias("positions")))
    return hits.join(segs, ["part", "seg"]).select(
        "positions", "start", "levels", "bitmaps", "ranks").mapInPandas(
        _read_tokens, "position long, token_id long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``documents`` as DAC files and report every document from the files."""
    path = new_folder(spark, "dac")
    write_token_files(read_table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
