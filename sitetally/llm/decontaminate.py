"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item the document is read in windows of as many words as the
item.  A window's 64-bit SimHash over its 5-word shingles (repeats count) is
looked up in a multi-index of the items' fingerprints: four blocks of 16 bits; a
fingerprint within ``RADIUS`` = 19 differs by at most 4 in one of them, so the
union of the four block neighbourhoods holds every item within the radius.
Candidates are verified by the exact weighted Jaccard similarity of the two
shingle multisets (sum of minima by sum of maxima).

Windows that share no shingle with any item of their size cannot reach a
similarity above 0 and are not fingerprinted; this screen loses nothing and
leaves most documents at one hash look-up a word.

Items go to the workers in blocks of ``BLOCK_ITEMS`` (a bound on what is shipped
at once); every block is matched against all documents, whatever their number.
No shuffle: hot sources and copies cost no more than other rows.

Defined cases: a NULL or empty text or item matches nothing; a document shorter
than an item is one window; items of fewer than five words match as a whole;
repeated rows are judged alike; an empty benchmark or table gives no matches;
other columns are kept untouched, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, importable, read_table, worker_table
from .shingles import WIDTH, in_groups, member, shingle_hashes, word_hashes, words_of_all

RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
SIMILARITY = 0.8
BLOCK_ITEMS = 2048
INDEX_ITEMS = 512
MATCHES = "array<struct<item_id:long,similarity:double,start_word:int,stop_word:int>>"

_BITS = np.arange(64, dtype=np.uint64)


def signs(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 values +1 or -1 per shingle hash."""
    return (((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * 2 - 1)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit SimHash of rows of summed signs, as uint64."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


class HammingIndex:
    """Items within a Hamming radius, by block neighbourhoods."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius, self.near = prints, radius, radius // BLOCKS
        values = np.arange(1 << BLOCK_BITS, dtype=np.uint16)
        self.tables = []
        for block in range(BLOCKS):
            own = ((prints >> np.uint64(BLOCK_BITS * block)) & np.uint64(0xFFFF)).astype(np.uint16)
            self.tables.append([
                np.packbits(np.bitwise_count(values[:, None] ^ own[i:i + 64]) <= self.near, axis=1,
                            bitorder="little") for i in range(0, len(own), 64)])

    def within(self, queries: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) positions at most the radius apart, among items ``chosen``."""
        blocks = [((queries >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF)).astype(np.int64)
                  for b in range(BLOCKS)]
        found_q, found_i = [], []
        for part in np.unique(chosen // 64):
            near = reduce(np.bitwise_or, (self.tables[b][part][blocks[b]] for b in range(BLOCKS)))
            q, i = np.nonzero(np.unpackbits(near, axis=1, bitorder="little"))
            i = i + part * 64
            keep = member(i, chosen)
            q, i = q[keep], i[keep]
            keep = np.bitwise_count(queries[q] ^ self.prints[i]) <= self.radius
            found_q.append(q[keep])
            found_i.append(i[keep])
        return np.concatenate(found_q), np.concatenate(found_i)


class Matcher:
    """Finds windows of a text that repeat items of one block."""

    def __init__(self, items: tuple[tuple[int, str], ...], similarity: float, radius: int):
        self.similarity = similarity
        words = [(i, word_hashes(text)) for i, text in items]
        words = [(i, w) for i, w in words if len(w)]
        self.ids = [i for i, _ in words]
        shingles = [shingle_hashes(w) for _, w in words]
        self.counts = [Counter(s.tolist()) for s in shingles]
        self.by_size: dict[int, np.ndarray] = {}
        sizes = np.array([len(w) for _, w in words], dtype=np.int64)
        self.known: dict[int, np.ndarray] = {}
        for size in np.unique(sizes):
            self.by_size[int(size)] = own = np.flatnonzero(sizes == size)
            self.known[int(size)] = np.unique(np.concatenate([shingles[k] for k in own]))
        self.widths = {w: np.unique(np.concatenate([self.known[s] for s in self.known
                                                    if min(s, WIDTH) == w]))
                       for w in {min(s, WIDTH) for s in self.known}}
        self.marks = {}
        for width, known in self.widths.items():
            self.marks[width] = marks = np.zeros(1 << 20, dtype=bool)
            marks[(known >> np.uint64(44)).astype(np.int64)] = True
        prints = (np.concatenate([fingerprints(signs(s).sum(axis=0, dtype=np.int64)[None, :])
                                  for s in shingles]) if shingles else np.empty(0, np.uint64))
        self.index = HammingIndex(prints, radius)

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """Best window per matched item: (item_id, similarity, start word, stop word)."""
        return self.find_words(word_hashes(text))

    def find_words(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """The same from the hashes of a text's words."""
        best = {}
        if not len(words):
            return []
        for width, known in self.widths.items():
            hashes = shingle_hashes(words, width)
            hits = np.flatnonzero(self.marks[width][(hashes >> np.uint64(44)).astype(np.int64)])
            hits = hits[member(hashes[hits], known)]
            if not len(hits):
                continue
            for size, own in self.by_size.items():
                if min(size, WIDTH) == width:
                    self._windows(len(words), hashes, hits, size, width, own, best)
        return [(self.ids[i], *x) for i, x in sorted(best.items())]

    def _windows(self, n, hashes, hits, size, width, own, best):
        """Fingerprint the windows of ``size`` words around ``hits``; keep verified ones."""
        hits = hits[member(hashes[hits], self.known[size])]
        if not len(hits):
            return
        span = min(size, n) - min(width, n) + 1            # shingles in a window
        last = len(hashes) - span                          # last window start
        marked = np.zeros(last + 2, dtype=np.int64)        # windows that hold a hit
        np.add.at(marked, np.clip(hits - span + 1, 0, last), 1)
        np.add.at(marked, np.clip(hits, 0, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(marked[:-1]) > 0)
        for piece in np.array_split(starts, -(-len(starts) // 4096)):
            first = int(piece[0])
            sums = np.zeros((int(piece[-1]) + span - first + 1, 64), dtype=np.int32)
            np.cumsum(signs(hashes[first:int(piece[-1]) + span]), axis=0, out=sums[1:])
            prints = fingerprints(sums[piece - first + span] - sums[piece - first])
            for q, i in zip(*(x.tolist() for x in self.index.within(prints, own))):
                start = int(piece[q])
                seen = Counter(hashes[start:start + span].tolist())
                common = (seen & self.counts[i]).total()
                value = common / (span + self.counts[i].total() - common)
                if value >= self.similarity and value > best.get(i, (0.0,))[0]:
                    best[i] = (value, start, start + min(size, n))


def _matchers(groups: list, similarity: float, radius: int) -> list[Matcher]:
    """The matchers of a block of items, kept by the block's hash while the stage runs."""
    key = ("matchers", hash(tuple(groups)), similarity, radius)
    return worker_table(key, lambda: [Matcher(g, similarity, radius) for g in groups])


def _matches_of(items: tuple, similarity: float, radius: int):
    groups = [items[i:i + INDEX_ITEMS] for i in range(0, len(items), INDEX_ITEMS)]

    @F.pandas_udf(MATCHES)
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matchers = _matchers(groups, similarity, radius)
        for texts in batches:
            yield pd.Series([
                [dict(zip(("item_id", "similarity", "start_word", "stop_word"), m))
                 for matcher in matchers for m in matcher.find_words(words)]
                for group in in_groups(texts.tolist()) for words in words_of_all(group)])
    return matches.asNondeterministic()


def match(docs: DataFrame, benchmark: DataFrame, into: str = "matches", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY,
          radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` with one more column ``into``: the items that each text repeats."""
    importable(docs.sparkSession)
    rows = (benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
                     .where("t is not null").toLocalIterator())
    found = F.array().cast(MATCHES)
    while block := tuple((r["i"], r["t"]) for r in islice(rows, block_items)):
        found = F.concat(found, _matches_of(block, similarity, radius)(F.col(text_col)))
    return docs.withColumn(into, found)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that repeat no benchmark item, with the same columns."""
    name = fresh(docs, "matches")
    return match(docs, benchmark, into=name, **options).where(F.size(name) == 0).drop(name)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark items: one row per document and item."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
