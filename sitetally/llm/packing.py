"""Bounded-space online packing of tokenised documents into fixed windows.

Every partition packs its documents in one pass with ``open_windows`` windows in
hand.  A document's full windows are emitted at once; its tail goes whole into
the open window that it fits best.  When it fits none, the fullest window is
filled up with the tail's first ids and emitted, and the rest takes its place.
What is still open at the end of a partition (at most ``open_windows`` windows)
is merged by the same rule in rounds of ``fan_in`` partitions, so no task sees
more than ``fan_in * open_windows`` windows and only the last round's fullest
windows can stay short.  Closed sequences are exactly ``window`` ids long.

Rows: one per piece.  Defined cases: a NULL or empty text is one end id; a NULL
or repeated ``doc_id`` is packed like any other row; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, read_table, staged
from .shingles import in_groups
from .tokens import GROUP_CHARS, default_vocabulary, encoder

GROUP_TEXTS = 4096
PIECE_COLS = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
PIECE_SCHEMA = ("doc_id string, start long, length long, doc_tokens long, ids binary, "
                "sequence_id long, offset long, open boolean, part long")


class _Packer:
    """Open windows of one task.  A piece is [doc_id, start, doc_tokens, ids]."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.open_windows = window, open_windows
        self.open: list[list] = []      # [free, pieces]
        self.next_id, self.out = first_id, []

    def _emit(self, pieces, is_open=False):
        offset = 0
        for doc_id, start, doc_tokens, ids in pieces:
            self.out.append((doc_id, start, len(ids), doc_tokens, ids, self.next_id, offset, is_open))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id, start, doc_tokens, ids):
        while len(ids) >= self.window:
            self._emit([(doc_id, start, doc_tokens, ids[:self.window])])
            start, ids = start + self.window, ids[self.window:]
        if len(ids):
            self._place(doc_id, start, doc_tokens, ids)

    def _place(self, doc_id, start, doc_tokens, ids):
        fits = [w for w in self.open if w[0] >= len(ids)]
        if fits:
            best = min(fits, key=lambda w: w[0])
            best[1].append((doc_id, start, doc_tokens, ids))
            best[0] -= len(ids)
            if best[0] == 0:
                self.open.remove(best)
                self._emit(best[1])
            return
        if len(self.open) == self.open_windows:
            fullest = min(self.open, key=lambda w: w[0])
            free = fullest[0]
            fullest[1].append((doc_id, start, doc_tokens, ids[:free]))
            self.open.remove(fullest)
            self._emit(fullest[1])
            self._place(doc_id, start + free, doc_tokens, ids[free:])
            return
        self.open.append([self.window - len(ids), [(doc_id, start, doc_tokens, ids)]])

    def drain(self, part: int) -> pd.DataFrame:
        out, self.out = self.out, []
        frame = pd.DataFrame(out, columns=[*PIECE_COLS, "open"])
        frame["ids"] = [x.tobytes() for x in frame["ids"]]
        frame["part"] = part
        return frame

    def close(self):
        for _, pieces in sorted(self.open, key=lambda w: w[0]):
            self._emit(pieces, is_open=True)
        self.open = []


def _first_id(round_no: int, part: int) -> int:
    """Sequence ids of a task: round, then task, then a 32-bit count."""
    return (round_no << 56) | (part << 32)


def _pack_documents(vocabulary: str, end_id: int, window: int, open_windows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        packer = _Packer(window, open_windows, _first_id(0, part))
        for batch in batches:
            doc_ids = iter(batch["doc_id"])
            for texts in in_groups(batch["text"].tolist(), GROUP_TEXTS, GROUP_CHARS):
                for ids in enc.encode_all(texts):
                    ids = np.concatenate((ids, end), dtype="<u4", casting="same_kind")
                    packer.add(next(doc_ids), 0, len(ids), ids)
                    if len(packer.out) >= 4096:
                        yield packer.drain(part)
            if packer.out:
                yield packer.drain(part)
        packer.close()
        if packer.out:
            yield packer.drain(part)
    return run


def _merge_group(round_no: int, window: int, open_windows: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        packer = _Packer(window, open_windows, _first_id(round_no, part))
        frame = frame.sort_values(["part", "sequence_id", "offset"], kind="stable")
        for doc_id, start, doc_tokens, ids in zip(frame["doc_id"], frame["start"],
                                                  frame["doc_tokens"], frame["ids"]):
            packer.add(doc_id, start, doc_tokens, np.frombuffer(ids, dtype="<u4"))
        packer.close()
        return packer.drain(part)
    return run


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, window: int = 2048,
         open_windows: int = 16, fan_in: int = 64, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, doc_tokens, ids (uint32
    little-endian bytes), sequence_id, offset."""
    importable(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    chosen_type = docs.schema[id_col].dataType
    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = staged(chosen.mapInPandas(
        _pack_documents(vocabulary, end_id, window, open_windows), PIECE_SCHEMA), "pack")
    done, left, round_no = pieces.where("not open"), pieces.where("open"), 0
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        round_no, parts = round_no + 1, -(-parts // fan_in)
        merged = staged(left.withColumn("group", F.floor(F.col("part") / fan_in))
                            .groupBy("group")
                            .applyInPandas(_merge_group(round_no, window, open_windows), PIECE_SCHEMA),
                        "pack-merge")
        done, left = done.unionByName(merged.where("not open")), merged.where("open")
    return (done.unionByName(left).select(*PIECE_COLS)
                .withColumn("doc_id", F.col("doc_id").cast(chosen_type)))


def _crc32(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["ids_crc32"] = [zlib.crc32(x) for x in batch["ids"]]
        yield batch.drop(columns="ids")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all ``documents`` into windows of 2048 ids."""
    pieces = pack(read_table(spark, sf_dir, "documents"))
    return pieces.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        _crc32, "doc_id string, start long, length long, doc_tokens long, sequence_id long, "
                "offset long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast("long"))
