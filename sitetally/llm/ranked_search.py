"""Ranked lexical search: all documents for every item, by presence masks.

Terms are runs of letters, digits and characters beyond ASCII; only A-Z are
lower-cased.  With N documents that have a term, L terms in all, n terms of a
document, df documents that hold a term and tf its occurrences in one, a term's
weight is w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's length factor
m = 25 + (75 n N) div L, and its score for an item the sum of
w * ((10**9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included.

Two passes over the documents' tasks, with a staged table between them:

1. *Blocks.*  ``BLOCK_DOCS`` neighbouring documents become one row: their ids and
   lengths, and for every term of the items the documents that hold it.  Only terms
   that an item asks for are kept.  N, L and df are sums over the blocks.
2. *Masks.*  Within a block every item sets one bit a term in a bitmap of the
   documents; documents with the same mask of matched terms are one group.  A mask's
   maximum score is the sum of its terms' largest contributions in the block.  Masks
   are evaluated by descending maximum, and a block is finished for an item when the
   k-th best score exceeds every maximum that is left.  The documents of evaluated
   masks get their exact scores.  A block gives at most k documents an item, so the
   best of all blocks need one small merge.

The items travel to the tasks: in groups of about ``GROUP_BYTES`` of text, each with
its own two passes, so that what is sent does not grow with the benchmark.

Defined cases: a NULL or empty text has no terms and is found by nothing; an item
without terms, or without documents above score 0, gives no rows; every benchmark
row is an item of its own (repeated rows each get their ranking); of equal scores
the smaller doc_id comes first, a NULL id last; repeated documents are ranked one
by one; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import importable, read_table, staged

TOP = 10
GROUP_BYTES = 8 << 20
BLOCK_DOCS = 8192
BLOCK_BYTES = 64 << 20
EVALUATED_AT_ONCE = 64
MERGE_SALTS = 32

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
              else 0x20 for b in range(256))

BLOCK_SCHEMA = ("n_docs int, n_with_terms long, n_terms long, ids array<long>, lengths binary, "
                "terms array<int>, df array<long>, docs binary, tf binary")
FOUND_SCHEMA = "item long, item_id long, doc_id long, score long"
_FOUND = pa.schema([(c.split()[0], pa.int64()) for c in FOUND_SCHEMA.split(", ")])


def terms(data: bytes) -> list[bytes]:
    """Terms of a UTF-8 text; bytes of characters beyond ASCII are never separators."""
    return data.translate(_FOLD).split()


class Items:
    """A group of items: the vocabulary they ask for, and each item's terms and repeats."""

    def __init__(self, rows: list[tuple[int, int | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}      # term -> number from 1
        self.items = []
        for number, item_id, text in rows:
            counts = Counter(terms((text or "").encode()))
            numbers = [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in counts]
            if numbers:
                self.items.append((number, item_id, np.array(numbers, dtype=np.int32),
                                   np.array(list(counts.values()), dtype=np.int64)))


# ---- pass 1: blocks ----------------------------------------------------------

def _block(ids: list, lengths: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
    """One row of ``BLOCK_SCHEMA``; a code is term * 2**16 + place of the document."""
    n = np.concatenate(lengths)
    code, tf = np.unique(np.concatenate(codes), return_counts=True)
    term, start = np.unique(code >> 16, return_index=True)
    df = np.diff(np.append(start, len(code)))
    row = {"n_docs": pa.array([len(n)], pa.int32()),
           "n_with_terms": pa.array([int(np.count_nonzero(n))], pa.int64()),
           "n_terms": pa.array([int(n.sum())], pa.int64()),
           "ids": pa.array([ids], pa.list_(pa.int64())),
           "lengths": pa.array([n.astype("<i8").tobytes()], pa.binary()),
           "terms": pa.array([term.astype(np.int32)], pa.list_(pa.int32())),
           "df": pa.array([df.astype(np.int64)], pa.list_(pa.int64())),
           "docs": pa.array([(code & 0xFFFF).astype("<u2").tobytes()], pa.binary()),
           "tf": pa.array([tf.astype("<u4").tobytes()], pa.binary())}
    return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


def _make_blocks(sent, block_docs: int = BLOCK_DOCS):
    if not 0 < block_docs <= 1 << 16:
        raise ValueError("a block holds 1 to 65536 documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_of = sent.value.vocabulary.get
        ids, lengths, codes, size = [], [], [], 0
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            batch_ids = batch.column("id").to_pylist()
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and stop - at < block_docs - len(ids) and held < 1 << 20:
                    held += len(texts[stop])
                    stop += 1
                found = [terms(t) for t in texts[at:stop]]
                n = np.fromiter(map(len, found), np.int64, stop - at)
                number = np.fromiter(map(number_of, chain.from_iterable(found), repeat(0)), np.int64, int(n.sum()))
                place = np.repeat(np.arange(len(ids), len(ids) + stop - at), n)
                asked = number > 0
                codes.append(number[asked] << 16 | place[asked])
                lengths.append(n)
                ids += batch_ids[at:stop]
                size += held
                at = stop
                if len(ids) >= block_docs or size >= BLOCK_BYTES:
                    yield _block(ids, lengths, codes)
                    ids, lengths, codes, size = [], [], [], 0
        if ids:
            yield _block(ids, lengths, codes)
    return run


# ---- pass 2: masks -----------------------------------------------------------

def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factors(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """25 + (75 n N) div L; in Python's integers where 64 bits would not do."""
    if 75 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 25 + 75 * n * n_docs // n_terms
    return np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)


class Block:
    """A block's postings, term by term, with their contributions."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs, self.ids = row["n_docs"], row["ids"]
        m = length_factors(np.frombuffer(row["lengths"], "<i8"), n_docs, n_terms)
        self.terms = np.array(row["terms"], dtype=np.int32)
        self.starts = np.concatenate(([0], np.cumsum(row["df"], dtype=np.int64)))
        self.docs = np.frombuffer(row["docs"], "<u2").astype(np.int64)
        tf = np.frombuffer(row["tf"], "<u4").astype(np.int64)
        share = 10**9 * tf // (1000 * tf + 8 * m[self.docs])
        self.gains = np.repeat(weights[self.terms], np.diff(self.starts)) * share
        self.most = (np.maximum.reduceat(self.gains, self.starts[:-1]) if len(self.terms)
                     else np.empty(0, dtype=np.int64))

    def groups(self, asked: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents with a term, mask number of each, maximum score of every mask).

        Bitmaps are made and compared 64 terms at a time; documents of equal masks so
        far keep one number.
        """
        number, most = np.zeros(self.n_docs, dtype=np.int64), np.zeros(self.n_docs, dtype=np.int64)
        some = np.zeros(self.n_docs, dtype=bool)
        for at in range(0, len(asked), 64):
            part, gain = asked[at:at + 64], self.most[asked[at:at + 64]] * repeats[at:at + 64]
            bits = np.zeros((64, self.n_docs), dtype=np.uint8)
            for row, t in enumerate(part.tolist()):
                bits[row, self.docs[self.starts[t]:self.starts[t + 1]]] = 1
            words = np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.uint64).ravel()
            masks, first, mask = np.unique(words, return_index=True, return_inverse=True)
            most += (gain @ bits[:len(part), first].astype(np.int64))[mask]
            some |= words != 0
            number = np.unique((number << 32) | mask, return_inverse=True)[1]
        docs = np.flatnonzero(some)
        _, first, mask = np.unique(number[docs], return_index=True, return_inverse=True)
        return docs, mask, most[docs[first]]

    def scores(self, docs: np.ndarray, asked: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Exact scores of a few documents."""
        out = np.zeros(len(docs), dtype=np.int64)
        for t, q in zip(asked.tolist(), repeats.tolist()):
            held = self.docs[self.starts[t]:self.starts[t + 1]]
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            out += np.where(held[at] == docs, q * self.gains[self.starts[t] + at], 0)
        return out

    def best(self, wanted: np.ndarray, repeats: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (place, score) above 0 for one item's terms and their repeats."""
        at = np.searchsorted(self.terms, wanted)
        there = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == wanted) \
            if len(self.terms) else np.zeros(len(wanted), dtype=bool)
        asked, repeats = at[there], repeats[there]
        if not len(asked):
            return []
        docs, mask, most = self.groups(asked, repeats)
        order = np.argsort(-most, kind="stable")
        size = np.bincount(mask, minlength=len(most))
        rank_of = np.empty(len(most), dtype=np.int64)
        rank_of[order] = np.arange(len(most))
        docs = docs[np.argsort(rank_of[mask], kind="stable")]       # by descending maximum of their mask
        stops = np.cumsum(size[order])
        found_docs, found, done, kth = [], [], 0, 0
        while done < len(order):
            if most[order[done]] <= 0 or sum(map(len, found)) >= k and most[order[done]] < kth:
                break                                               # equal maxima may still win by id
            first = stops[done - 1] if done else 0
            last = max(done + 1, int(np.searchsorted(stops, first + EVALUATED_AT_ONCE, "right")))
            part = docs[first:stops[last - 1]]
            found_docs.append(part)
            found.append(self.scores(part, asked, repeats))
            done = last
            scores = np.concatenate(found)
            kth = np.partition(scores, -k)[-k] if len(scores) >= k else 0
        places, scores = np.concatenate(found_docs or [docs[:0]]), np.concatenate(found or [docs[:0]])
        rows = [(p, s) for p, s in zip(places.tolist(), scores.tolist()) if s > 0 and s >= kth]
        rows.sort(key=lambda r: (-r[1], self.ids[r[0]] is None, self.ids[r[0]] or 0))
        return rows[:k]


def _search_blocks(sent, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, weights, n_docs, n_terms)
                found = [(number, item_id, block.ids[place], score)
                         for number, item_id, wanted, repeats in sent.value.items
                         for place, score in block.best(wanted, repeats, k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[c] for f in found], pa.int64()) for c in range(4)], schema=_FOUND)
    return run


def _item_groups(items: DataFrame, group_bytes: int) -> Iterator[list[tuple]]:
    """The items' rows, in groups of about ``group_bytes``; one item is never split."""
    items = staged(items.withColumn("item", F.monotonically_increasing_id()), "search-items")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    whole = items.agg(F.sum(size)).first()[0] or 0
    groups = max(1, -(-whole // group_bytes))
    while True:
        dealt = items.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)))
        largest = dealt.groupBy("group").agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).where(
            F.col("n") > 1).agg(F.max("bytes")).first()[0] or 0
        if largest <= 2 * group_bytes:
            break
        groups *= 2
    for group in range(groups):
        yield [(r["item"], r["id"], r["text"]) for r in dealt.where(F.col("group") == group).collect()]


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", group_bytes: int = GROUP_BYTES,
           block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` highest-scoring documents of every item."""
    spark = docs.sparkSession
    importable(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    parts = []
    for rows in _item_groups(items, group_bytes):
        asked = Items(rows)
        if not asked.items:
            continue
        sent = spark.sparkContext.broadcast(asked)
        blocks = staged(docs.mapInArrow(_make_blocks(sent, block_docs), BLOCK_SCHEMA), "search-blocks")
        n_docs, n_terms = blocks.agg(F.sum("n_with_terms"), F.sum("n_terms")).first()
        if not n_docs:
            continue
        counts = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(
            F.sum("t.df").alias("df")).collect()        # at most the group's vocabulary
        weights = np.zeros(len(asked.vocabulary) + 1, dtype=np.int64)
        for r in counts:
            weights[r["terms"]] = weight(n_docs, r["df"])
        parts.append(blocks.mapInArrow(_search_blocks(sent, weights, n_docs, n_terms, k), FOUND_SCHEMA))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = reduce(DataFrame.unionByName, parts).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_SALTS)))
    best = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for keys in (["item", "salt"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(
            F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP12_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents),
sizes AS (
  SELECT d, doc_id, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
asked AS (
  SELECT i, item_id, term, count(*) AS q
  FROM (SELECT i, item_id, unnest(terms) AS term
        FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark))
  GROUP BY i, item_id, term),
held AS (
  SELECT d, term, count(*) AS tf
  FROM (SELECT d, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked)
  GROUP BY d, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals),
scored AS (
  SELECT a.i, a.item_id, s.d, s.doc_id,
         CAST(sum(a.q * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (25 + (75 * s.n * t.n_docs) // t.n_terms))))
              AS BIGINT) AS score
  FROM asked a JOIN held h ON a.term = h.term JOIN weights w ON a.term = w.term JOIN sizes s ON h.d = s.d, totals t
  GROUP BY a.i, a.item_id, s.d, s.doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
         doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
