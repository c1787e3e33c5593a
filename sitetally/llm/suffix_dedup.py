"""Repeated-substring removal by external induced suffix sorting, in shards.

Every byte that lies in a string of ``LENGTH`` = 400 bytes which also starts
anywhere else, in its own text or another, is removed.

Sharding.  A 400-byte window is dealt by its anchor hash (``anchors``), which
depends on its bytes alone, so equal windows meet in one shard.  Anchors whose
hash occurs once speak for no repeated window and are dropped.  Where all
contexts of a hash are the same bytes, all their windows repeat; copies, however
many, are thus settled by counting.  Where contexts differ, those that share one of
four stretches around the anchor with another (every shared window covers one) go,
one of each sort, to the hash's shard, which sorts the suffixes of all its contexts
(``induced_sort``: priority queues in the shared folder once they outgrow memory)
and reports the windows whose common prefix with a neighbour reaches 400.

Texts are known by a 64-bit hash of their bytes, so repeated rows, copies and
rows without id need no id of their own.

Defined cases: a NULL or empty text has 0 bytes and no spans (its hash is that of
no bytes); texts shorter than 400 bytes keep all; of repeated rows all are
removed where their windows repeat; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import SCREENS, screened_anchors
from .common import importable, large_arrays_apart, new_folder, read_table, staged, whole_text
from .induced_sort import Scratch, repeated_starts

LENGTH = 400
SHARD_BYTES = 8 << 20

ANCHOR_SCHEMA = "t long, id string, first int, n int, key long, ctx long, " + ", ".join(
    f"screen{k} int" for k in range(SCREENS))
CONTEXT_SCHEMA = "key long, ctx long, copies long, n int, bytes binary"
WINDOW_SCHEMA = "key long, ctx long, start int, stop int"


def _context(data: bytes, first: int, n: int, length: int) -> bytes:
    return data[first:first + n + length - 1]


def _find_anchors(length: int):
    def rows(held: list) -> pd.DataFrame:
        t, row_id, n_anchors, *columns = zip(*held)
        first, n, key, ctx, screens, outside = (np.concatenate(c) for c in columns)
        return pd.DataFrame({"t": np.repeat(np.array(t, dtype=np.int64), n_anchors),
                             "id": np.repeat(np.array(row_id, dtype=object), n_anchors),
                             "first": first, "n": n, "key": key, "ctx": ctx.view(np.int64),
                             **{f"screen{k}": pd.arrays.IntegerArray(
                                 np.ascontiguousarray(screens[:, k]), outside[:, k].copy())
                                for k in range(SCREENS)}})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for t, row_id, text in zip(batch["t"], batch["id"], batch["text"]):
                data = text.encode()
                if len(data) < length:
                    continue
                first, n, key, _, screens, outside = screened_anchors(data, length)
                ctx = np.fromiter((xxhash.xxh3_64_intdigest(_context(data, a, b, length))
                                   for a, b in zip(first.tolist(), n.tolist())), np.uint64, len(first))
                # arrays only; a frame for each text costs more than its anchors
                held.append((t, row_id, len(first), first, n, key, ctx, screens, outside))
                size += len(first)
                if size > 50_000:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)
    return run


def _cut_contexts(length: int):
    columns = ["key", "ctx", "copies", "n", "bytes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for text, wanted in zip(batch["text"], batch["wanted"]):
                data = text.encode()
                for w in wanted:
                    held.append((w["key"], w["ctx"], w["copies"], w["n"],
                                 _context(data, w["first"], w["n"], length)))
                    size += len(held[-1][-1])
                    if size > 1 << 20:
                        yield pd.DataFrame(held, columns=columns)
                        held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=columns)
    return run


def _sort_shard(length: int, scratch_uri: str):
    """Windows of a shard's contexts that repeat, as runs (start, stop) of window starts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        large_arrays_apart()
        parts, rows = [np.zeros(1, dtype=np.uint8)], []
        for batch in batches:
            for row in batch.drop_duplicates(["key", "ctx"]).itertuples(index=False):
                parts.append(np.frombuffer(row.bytes + b"\xff", dtype=np.uint8) + np.uint8(1))
                rows.append((row.key, row.ctx, row.copies, row.n, len(row.bytes)))
        if not rows:
            return
        key, ctx, copies, _, size = (np.array(x, dtype=np.int64) for x in zip(*rows))
        text = np.concatenate(parts)
        del parts
        scratch = Scratch(scratch_uri)
        try:
            mask = repeated_starts(text, length, scratch)
        finally:
            scratch.close()
        begin = 1 + np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(begin, start, "right") - 1
        asked = copies[of] == 1         # of contexts that occur twice all windows repeat anyway
        start, stop, of = start[asked], stop[asked], of[asked]
        yield pd.DataFrame({"key": key[of], "ctx": ctx[of], "start": (start - begin[of]).astype(np.int32),
                            "stop": (stop - begin[of]).astype(np.int32)})
    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))


def repeated_windows(texts: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(t, start, stop) of window starts that repeat; ``texts``: id, text, t."""
    spark = texts.sparkSession
    importable(spark)
    found = staged(texts.select("t", F.col("id").cast("string").alias("id"), "text")
                        .where(F.octet_length("text") >= length)
                        .mapInPandas(_find_anchors(length), ANCHOR_SCHEMA), "dedup-anchors")
    # staged by itself, so that the join deals both sides anew and can split a hot key
    shared = staged(found.groupBy("key").agg(F.count("*").alias("rows"), F.min("ctx").alias("low"),
                                             F.max("ctx").alias("high"))
                         .where("rows > 1")
                         .select("key", (F.col("low") != F.col("high")).alias("mixed")), "dedup-keys")
    shared = staged(found.join(shared, "key"), "dedup-shared")
    mixed = shared.where("mixed")
    one_each = staged(mixed.groupBy("key", "ctx").agg(
        F.count("*").alias("copies"), F.min(F.struct("t", "id", "first", "n")).alias("at"),
        *[F.first(f"screen{k}").alias(f"screen{k}") for k in range(SCREENS)]), "dedup-contexts")
    stretches = one_each.select("key", "ctx", "copies", F.posexplode(F.array(
        *[f"screen{k}" for k in range(SCREENS)])).alias("k", "stretch")) \
        .where("stretch is not null")
    met = (stretches.groupBy("key", "k", "stretch").agg(F.count("*").alias("rows"), F.min("copies").alias("least"))
                    .where("rows > 1 and least = 1").drop("rows", "least"))
    doubtful = stretches.join(met, ["key", "k", "stretch"]).select("key", "ctx").distinct()
    wanted = staged(one_each.select("key", "ctx", "copies", "at").join(doubtful, ["key", "ctx"]).groupBy("at.t", "at.id").agg(
        F.collect_list(F.struct("key", "ctx", "copies", "at.first", "at.n")).alias("wanted"),
        F.sum(F.col("at.n") + (length - 1)).alias("size")), "dedup-wanted")
    total = wanted.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    same = F.col("w_t").eqNullSafe(F.col("t")) & F.col("w_id").eqNullSafe(F.col("id").cast("string"))
    # a merge join whatever the sizes: texts are dealt alike at every scale
    contexts = (texts.join(wanted.select(F.col("t").alias("w_t"), F.col("id").alias("w_id"), "wanted")
                                 .hint("merge"), same)
                     .select("text", "wanted").mapInPandas(_cut_contexts(length), CONTEXT_SCHEMA))
    windows = staged(contexts.repartition(shards, "key").mapInPandas(
        _sort_shard(length, new_folder(spark, "dedup-queues")), WINDOW_SCHEMA), "dedup-windows")
    settled = shared.where("not mixed").select(
        "t", F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("stop"))
    windows = windows.unionByName(one_each.where("copies > 1").select(
        "key", "ctx", F.lit(0).alias("start"), F.col("at.n").alias("stop")))
    sorted_out = mixed.join(windows, ["key", "ctx"]).select(
        "t", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"))
    return settled.unionByName(sorted_out)


def _merged(length: int):
    """Window runs to removed byte spans, in order and apart."""
    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def merge(runs: pd.Series) -> pd.Series:
        out = []
        for own in runs:
            start = np.array([r["start"] for r in own], dtype=np.int64)
            stop = np.array([r["stop"] for r in own], dtype=np.int64) + (length - 1)
            order = np.argsort(start, kind="stable")
            start, stop = start[order], np.maximum.accumulate(stop[order])
            new = np.concatenate(([True], start[1:] > stop[:-1]))
            last = np.append(np.flatnonzero(new)[1:], len(start)) - 1
            out.append([{"start": int(a), "stop": int(b)} for a, b in zip(start[new], stop[last])])
        return pd.Series(out)
    return merge


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, ``spans`` (removed, start and stop in
    bytes) and ``kept`` (the remaining bytes)."""
    texts = _texts(docs, id_col, text_col)
    runs = repeated_windows(texts, length, shard_bytes)
    spans = runs.distinct().groupBy(F.col("t").alias("s_t")).agg(
        F.collect_list(F.struct("start", "stop")).alias("runs"))
    spans = staged(spans.select("s_t", _merged(length)("runs").alias("spans")), "dedup-spans")
    data = F.encode("text", "UTF-8")
    start = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out"))
    kept = F.aggregate("spans", start, lambda acc, s: F.struct(
        s["stop"].alias("at"),
        F.concat(acc["out"], F.substring(data, acc["at"] + 1, s["start"] - acc["at"])).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(data, acc["at"] + 1, F.length(data))))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return texts.join(spans.hint("merge"), texts["t"] == spans["s_t"], "left").select(
        F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce("spans", none).alias("spans"),
        F.when(F.col("spans").isNull(), data).otherwise(kept).alias("kept"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document."""
    rows = remove_repeats(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
