"""True links between sets of shingles, found in buckets and confirmed on full sets.

A search method (bands, chosen shingles) deals sets into buckets; what follows is the
same for all of them and needs neither all pairs of a bucket nor a whole group in one
task:

1. *First links.*  In the buckets of the first rows every set is tied to one set that the
   sketches hold near: in buckets of up to ``small`` sets the first such one, in larger
   ones up to ``PIVOTS`` sets of the bucket.  These pairs are compared on their full
   sets; true links are united (``components``).
2. *The rest.*  Buckets that lie within one group need nothing more.  In the others each
   near pair of different groups is compared on the full sets, inside the bucket, best
   estimates first; pairs whose groups meet on the way are skipped.  A bucket of more
   than ``small`` sets is compared in parts, the sets outside its largest group against
   all, if that makes at most ``SPREAD`` rows a set; else the search method splits it, at
   most ``depth`` times, before that.  Buckets whose full sets are large in bytes give pairs
   instead, which are joined.

Sets are rows ``s`` (a number of its own), ``t1, t2`` (a 128-bit hash of one of its
texts), ``size`` and ``sketch`` (bytes).  Documents are ``t1, t2, text`` (binary).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components
from .shingles import in_groups, member

SMALL = 1024
PIVOTS = 8
PART, SPREAD = 2, 3             # parts of large buckets hold PART * small sets; rows a set that they may make
PAIRS_AT_ONCE = 1 << 12         # pairs whose sketches are compared at a time
LARGE, ROWS_AT_ONCE = 48, 256   # rows of a bucket whose pairs are chosen by products; so many rows at a time
SIGMAS = 5.5
FEW_PAIRS = 32                  # up to so many pairs of a bucket are compared one by one
MARK_BYTES = 32 << 20           # marks of a bucket's common shingles that are held at a time
MARKED_AT_ONCE = 1 << 20        # shingles whose marks are made at a time
HEAVY_BYTES = 64 << 20          # full sets of a bucket that one task takes in
BROADCAST_ROWS = 200_000        # rows of 24 bytes


@dataclass(frozen=True)
class Rule:
    """What is a link, and how the sketches estimate it.  Functions are module level ones,
    so that tasks import them."""

    percent: int                                            # 100 * intersection >= percent * union
    least: float                                            # estimate from which on a pair is compared
    estimate: Callable[[np.ndarray, np.ndarray], np.ndarray]    # of prepared rows of sketches
    prepared: Callable[[np.ndarray], np.ndarray]            # rows of sketches as ``estimate`` takes them
    shingles: Callable[[list[bytes]], list[np.ndarray]]     # sorted distinct hashes of each text
    zero_is_empty: bool = False                             # a sketch byte of 0 stands for no value
    first_bucket: Callable | None = None                    # (frame, i, j) -> pairs to compare here
    small: int = SMALL
    heavy: int = HEAVY_BYTES
    depth: int = 3


def _unpacked(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), -1)


def whole_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames that end with a bucket's last row; rows come sorted by node."""
    rest = None
    for batch in batches:
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        node = frame["node"].to_numpy()
        cut = int(np.searchsorted(node, node[-1], "left")) if len(node) else 0
        rest = frame.iloc[cut:]
        if cut:
            yield frame.iloc[:cut]
    if rest is not None and len(rest):
        yield rest


def _signs(rows: np.ndarray, percent: int, zero_is_empty: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sketch rows as +1 and -1 by the lowest bit of each byte (0 for an empty one), and what
    the product of a row with that of a link reaches at least.

    Equal bytes add 1 to a product, others 1 or -1 with equal odds: of ``used`` bytes, that
    of a link has mean ``s * used`` and variance ``(1 - s * s) * used``; the bound lies
    ``SIGMAS`` below the mean.  It grows with ``used``, so each row's own bytes bound it."""
    signs = (rows & 1).astype(np.float32) * 2 - 1
    used = np.full(len(rows), rows.shape[1])
    if zero_is_empty:
        signs[rows == 0] = 0
        used = np.count_nonzero(rows, axis=1)
    s = percent / 100
    return signs, np.maximum(s * used - SIGMAS * np.sqrt((1 - s * s) * used), -used).astype(np.float32)


def _near_in_large(rows: np.ndarray, first: int, group, side, prepared, rule: Rule, done) -> Iterator[tuple]:
    """``_near_pairs`` of one bucket from row ``first`` on: products of signs leave few pairs."""
    signs, least = _signs(rows, rule.percent, rule.zero_is_empty)
    n = len(rows)
    for at in range(0, n, ROWS_AT_ONCE):
        stop = min(at + ROWS_AT_ONCE, n)
        product = signs[at:stop] @ signs[at:].T
        may = (product >= least[at:stop, None]) & (product >= least[at:])
        may &= group[at:stop, None] != group[at:]
        may &= (side[at:stop, None] != side[at:]) | (side[at:] == 0)
        if done is not None:
            may &= ~(done[first + at:first + stop, None] & done[first + at:first + n])
        i, j = np.nonzero(np.triu(may, 1))
        i, j = i + (first + at), j + (first + at)
        for k in range(0, len(i), PAIRS_AT_ONCE):
            a, b = i[k:k + PAIRS_AT_ONCE], j[k:k + PAIRS_AT_ONCE]
            if done is not None:
                use = ~(done[a] & done[b])
                a, b = a[use], b[use]
            found = rule.estimate(prepared[a], prepared[b])
            near = found >= rule.least
            if near.any():
                yield a[near], b[near], found[near]


def _near_pairs(frame: pd.DataFrame, rule: Rule,
                done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, estimate) of near rows of the same bucket and different groups, i < j; pairs of
    rows that are both ``done`` by then are left out."""
    node, group = frame["node"].to_numpy(), frame["group"].to_numpy()
    side = frame["side"].to_numpy()
    unpacked = _unpacked(frame["sketch"])
    rows = rule.prepared(unpacked)
    edges = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
    small = np.ones(len(node), dtype=bool)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if hi - lo >= LARGE:
            small[lo:hi] = False
            yield from _near_in_large(unpacked[lo:hi], lo, group[lo:hi], side[lo:hi], rows, rule, done)
    i, step = np.flatnonzero(small), 1
    while True:
        i = i[i + step < len(node)]
        i = i[node[i] == node[i + step]]
        if not len(i):
            return
        use = i[(group[i] != group[i + step]) & ((side[i] != side[i + step]) | (side[i] == 0))]
        if done is not None:
            use = use[~(done[use] & done[use + step])]
        for at in range(0, len(use), PAIRS_AT_ONCE):
            a = use[at:at + PAIRS_AT_ONCE]
            found = rule.estimate(rows[a], rows[a + step])
            near = found >= rule.least
            if near.any():
                yield a[near], a[near] + step, found[near]
        step += 1


def _tie_small(rule: Rule):
    """Every row's first near row of its bucket."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_buckets(batches):
            first = np.full(len(frame), len(frame), dtype=np.int64)
            for i, j, _ in _near_pairs(frame, rule):
                np.minimum.at(first, j, i)
            j = np.flatnonzero(first < len(frame))
            if len(j):
                s = frame["s"].to_numpy()
                yield pd.DataFrame({"a": s[j], "b": s[first[j]]}).drop_duplicates()
    return run


def _flag(rule: Rule):
    """Rows that have a near row in their bucket."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_buckets(batches):
            flagged = np.zeros(len(frame), dtype=bool)
            for i, j, _ in _near_pairs(frame, rule, flagged):
                flagged[i] = flagged[j] = True
            if flagged.any():
                yield frame.loc[flagged, ["node", "s"]]
    return run


def _pairs(rule: Rule):
    """All near pairs of buckets whose full sets are too large for one task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_buckets(batches):
            s = frame["s"].to_numpy()
            for i, j, _ in _near_pairs(frame, rule):
                yield pd.DataFrame({"a": s[j], "b": s[i]})
    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    both = int(np.count_nonzero(member(small, large)))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sums(counts: np.ndarray) -> np.ndarray:
    """Sums of rows of small counts, one byte each, eight at a time."""
    low, words = np.uint64(0x00FF00FF00FF00FF), counts.view(np.uint64)
    out = np.zeros(len(words), dtype=np.uint64)
    for k in range(0, words.shape[1], 16):      # 16 bytes of at most 8 fit in one
        part = words[:, k]
        for n in range(k + 1, min(k + 16, words.shape[1])):
            part = part + words[:, n]
        part = (part & low) + ((part >> np.uint64(8)) & low)
        out += (part * np.uint64(0x0001000100010001)) >> np.uint64(48)
    return out.astype(np.int64)


def zero_bytes(rows: np.ndarray) -> np.ndarray:
    """How many bytes of each row of 64-bit words are zero; rows are whole in 64 bytes."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    filled = ((rows & low) + low) | rows | low
    return _sums(np.bitwise_count(~filled))


class _Marks:
    """Intersections of a bucket's sets, from bits that mark which of the shingles that
    several of them hold each one holds.  Shingles are taken by ranges of their hash."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size, self.held = sets, np.array([len(x) for x in sets], dtype=np.int64), []
        for marks in self._all():
            self.held.append(marks)
            if sum(x.nbytes for x in self.held) > MARK_BYTES:
                self.held = None
                break

    def _all(self) -> Iterator[np.ndarray]:
        """Marks of the sets, some shingles after the others."""
        parts = max(1, -(-int(self.size.sum()) // MARKED_AT_ONCE))
        edges = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
        cuts = [[0, *np.searchsorted(x, edges).tolist(), len(x)] for x in self.sets]
        for k in range(parts):
            yield from self._marks([x[c[k]:c[k + 1]] for x, c in zip(self.sets, cuts)])

    def _marks(self, sets: list[np.ndarray]) -> Iterator[np.ndarray]:
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))[:len(hashes)]
        shared = ~(new & np.concatenate((new[1:], [True]))[:len(hashes)])
        owner, column = owner[shared], np.cumsum(new[shared]) - 1
        columns = int(column[-1]) + 1 if len(column) else 0
        width = max(64, MARK_BYTES // len(sets) * 8 // 64 * 64)
        for start in range(0, columns, width):
            lo, hi = np.searchsorted(column, (start, start + width))
            words = -(-min(width, columns - start) // 64)
            marks, at = np.zeros((len(sets), words * 8), dtype=np.uint8), column[lo:hi] - start
            np.bitwise_or.at(marks, (owner[lo:hi], at >> 3), (1 << (at & 7)).astype(np.uint8))
            yield marks.view(np.uint64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.int64)
        for marks in self._all() if self.held is None else self.held:
            step = max(1, (1 << 17) // marks.shape[1])
            for at in range(0, len(i), step):
                both = marks[i[at:at + step]] & marks[j[at:at + step]]
                out[at:at + step] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        return out

    def linked(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs have 100 * intersection >= percent * union."""
        both = self.common(i, j)
        return 100 * both >= percent * (self.size[i] + self.size[j] - both)


def _united(group: np.ndarray, first: int, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray,
            percent: int) -> list[tuple]:
    """Pairs of a bucket, best first, that are links and bring groups together.

    ``group`` has the groups of all rows, those of the bucket from ``first`` on; groups
    that meet become one in it."""
    links = []

    def unite(a: int, b: int):
        links.append((first + a, first + b))
        one, two = group[first + a], group[first + b]
        group[group == max(one, two)] = min(one, two)

    if len(i) <= FEW_PAIRS:
        for a, b in zip(i.tolist(), j.tolist()):
            if group[first + a] != group[first + b] and linked(sets[a], sets[b], percent):
                unite(a, b)
        return links
    marks, at = _Marks(sets), 0
    step = 1 << 15 if marks.held is None else FEW_PAIRS     # marks that are not held are made for each step
    while at < len(i):
        a, b = i[at:at + step], j[at:at + step]
        apart = group[first + a] != group[first + b]
        a, b = a[apart], b[apart]
        if len(a):
            true = marks.linked(a, b, percent)
            for x, y in zip(a[true].tolist(), b[true].tolist()):
                if group[first + x] != group[first + y]:
                    unite(x, y)
        at, step = at + step, min(2 * step, 1 << 15)
    return links


def _unite(rule: Rule):
    """Links between groups of a bucket, on full sets; best estimates first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_buckets(batches):
            found = [(i.astype(np.int32), j.astype(np.int32), near.astype(np.float32))
                     for i, j, near in _near_pairs(frame, rule)]
            if not found:
                continue
            i, j, near = (np.concatenate(x) for x in zip(*found))
            if rule.first_bucket:
                here = rule.first_bucket(frame, i, j)
                i, j, near = i[here], j[here], near[here]
            node, group = frame["node"].to_numpy(), np.unique(frame["group"].to_numpy(), return_inverse=True)[1]
            edges = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
            bucket = (np.searchsorted(edges, i, "right") - 1).astype(np.int32)
            order = np.lexsort((-near, bucket))
            i, j, bucket = i[order], j[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(i) else [0]
            s, shingles, links = frame["s"].to_numpy(), frame["shingles"].to_numpy(), []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                first, stop = edges[bucket[lo]], edges[bucket[lo] + 1]
                sets = [np.frombuffer(x, np.uint64) for x in shingles[first:stop]]
                links += [(int(s[a]), int(s[b])) for a, b in _united(
                    group, int(first), sets, i[lo:hi] - first, j[lo:hi] - first, rule.percent)]
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])
    return run


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node", "s")


# ---- full sets ---------------------------------------------------------------

def full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, shingles: Callable) -> DataFrame:
    """(s, shingles) of the wanted sets, from the text of one document each."""
    wanted = staged(wanted.select("s").distinct().join(sets.select("s", "t1", "t2"), "s"), "near-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    @F.arrow_udf("binary")
    def shingled(texts: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for group in in_groups(texts.to_pylist()) for x in shingles(group)], pa.binary())

    texts = docs.join(wanted, ["t1", "t2"]).dropDuplicates(["s"])
    return staged(texts.select("s", shingled("text").alias("shingles")), "near-shingles")


def _true_links(pairs: DataFrame, full: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are links, by a join of both full sets."""
    @F.arrow_udf("boolean")
    def is_link(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), rule.percent)
                         for x, y in zip(a, b)], pa.bool_())

    both = pairs.join(full.select(F.col("s").alias("a"), F.col("shingles").alias("x")), "a").join(
        full.select(F.col("s").alias("b"), F.col("shingles").alias("y")), "b")
    return both.where(is_link("x", "y")).select("a", "b")


# ---- the two rounds ----------------------------------------------------------

def _pivot_pairs(large: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of a set and the pivots of its large buckets that come near; large: s, node, sketch."""
    pivots = (large.groupBy("node", F.pmod(F.xxhash64("s"), F.lit(PIVOTS)).alias("class"))
                   .agg(F.min(F.struct(F.xxhash64("s", F.lit(1)), "s", "sketch")).alias("pivot"))
                   .groupBy("node").agg(F.collect_list(F.struct("pivot.s", "pivot.sketch")).alias("pivots")))

    @F.pandas_udf("array<long>")
    def near_pivots(s: pd.Series, sketch: pd.Series, ids: pd.Series, sketches: pd.Series) -> pd.Series:
        out = []
        for own, mine, who, rows in zip(s, sketch, ids, sketches):
            rows = rule.prepared(_unpacked([*rows, mine]))
            near = rule.estimate(rows[:-1], np.broadcast_to(rows[-1], rows[:-1].shape)) >= rule.least
            out.append([int(p) for p, ok in zip(who, near) if ok and p != own])
        return pd.Series(out)

    tied = large.join(pivots, "node").select(
        "s", near_pivots("s", "sketch", "pivots.s", "pivots.sketch").alias("to"))
    return (tied.groupBy("s").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))
                .select(F.col("s").alias("a"), F.explode("to").alias("b")))


def _first_links(docs: DataFrame, sets: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    rows = rows.select("s", "node")
    sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    met = staged(rows.join(sizes, "node").join(sets.select("s", "sketch"), "s"), "links-first")
    met = met.withColumn("group", F.col("s")).withColumn("side", F.lit(0))
    pairs = _by_bucket(met.where(F.col("n") <= rule.small)).mapInPandas(_tie_small(rule), "a long, b long")
    large = met.where(F.col("n") > rule.small)
    if not large.isEmpty():
        pairs = pairs.unionByName(_pivot_pairs(large, rule))
    pairs = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links-pairs")
    full = full_sets(docs, sets, pairs.select(F.explode(F.array("a", "b")).alias("s")), rule.shingles)
    return staged(_true_links(pairs, full, rule), "links-first-true")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one group, with their bucket's size in sets and bytes."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"),
                                     F.min("group").alias("low"), F.max("group").alias("high"))
    return rows.join(sizes.where("low < high").select("node", "n", "shingles"), "node")


def _outside(rows: DataFrame) -> DataFrame:
    """(node, main, outside, n): a bucket's largest group, sets outside it, and all sets."""
    sizes = rows.groupBy("node", "group").agg(F.count("*").alias("k"))
    return sizes.groupBy("node").agg(F.max_by("group", "k").alias("main"), F.sum("k").alias("n"),
                                     (F.sum("k") - F.max("k")).alias("outside"))


def _part_counts(small: int):
    """Parts of a large bucket: of the sets outside its largest group, and of all its sets."""
    part = F.lit(PART * small)
    return (F.greatest(F.ceil(F.col("outside") / part), F.lit(1)).cast("int"),
            F.ceil(F.col("n") / part).cast("int"))


def _in_parts(small: int):
    """Whether a large bucket in parts makes at most ``SPREAD`` rows a set.  A split makes about
    two, and where sets share most of what they hold its buckets are hardly smaller."""
    outer, every = _part_counts(small)
    return F.col("n") * outer + F.col("outside") * every <= SPREAD * F.col("n")


def _parts(rows: DataFrame, small: int) -> DataFrame:
    """Large buckets as pairs of parts: sets outside the largest group against all.

    ``rows`` have ``main``, ``outside`` and ``n``.  Parts of the outside sets are numbered
    o, parts of all sets p; a set is once in every (o, its p), an outside set also in every
    (its o, p).  Sides 1 and 2 are compared with each other only; a pair of outside sets
    meets in (o, p) of either."""
    def dealt(count, salt):
        return F.pmod(F.xxhash64("s", F.lit(salt)), count).cast("int")

    outer, every = _part_counts(small)
    met = F.transform(F.sequence(F.lit(0), outer - 1), lambda o: F.struct(
        o.alias("o"), dealt(every, 5).alias("p"), F.lit(2).alias("side")))
    own = F.when(F.col("group") != F.col("main"), F.transform(F.sequence(F.lit(0), every - 1), lambda p: F.struct(
        dealt(outer, 6).alias("o"), p.alias("p"), F.lit(1).alias("side"))))
    none = F.array().cast("array<struct<o:int,p:int,side:int>>")
    rows = rows.withColumn("pair", F.explode(F.concat(met, F.coalesce(own, none))))
    return rows.select("s", F.xxhash64("node", "pair.o", "pair.p").alias("node"), "band", "group", "size",
                       F.col("pair.side").alias("side"))


def _other_links(docs: DataFrame, sets: DataFrame, rows: DataFrame, split: Callable, rule: Rule) -> DataFrame:
    """Links between the groups of ``sets``, from the rows (s, band, node, group, size).

    Sketches are far larger than these rows: they are joined once, to the buckets compared."""
    met = staged(_mixed(rows), "links-mixed")
    one = met.where(F.col("n") <= rule.small).withColumn("side", F.lit(0))
    bits = one.groupBy("s").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("bits"))
    no_bits = F.lit(0).cast("long")
    buckets, dealt, large = [one.hint("merge").join(bits, "s")], [], met.where(F.col("n") > rule.small)
    for depth in range(rule.depth + 1):
        if large.isEmpty():
            break
        known = staged(large.drop("n", "shingles").hint("merge").join(_outside(large), "node"), "links-large")
        if depth == rule.depth:
            dealt.append(known)
            break
        dealt.append(known.where(_in_parts(rule.small)))
        finer = staged(split(known.where(~_in_parts(rule.small)).drop("n", "main", "outside"), depth), "links-split")
        met = staged(_mixed(finer), "links-split-mixed")
        buckets.append(met.where(F.col("n") <= rule.small).withColumn("side", F.lit(0)).withColumn("bits", no_bits))
        large = met.where(F.col("n") > rule.small)
    if dealt:
        parts = staged(_parts(reduce(DataFrame.unionByName, dealt), rule.small), "links-parts")
        of = parts.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
        buckets.append(parts.hint("merge").join(of, "node").withColumn("bits", no_bits))
    columns = ["node", "s", "band", "group", "side", "bits", "shingles"]
    rows = reduce(DataFrame.unionByName, [b.select(*columns) for b in buckets])
    rows = staged(rows.hint("merge").join(sets.select("s", "sketch"), "s"), "links-buckets")
    flagged = staged(_by_bucket(rows).mapInPandas(_flag(rule), "node long, s long"), "links-flagged")
    full = full_sets(docs, sets, flagged, rule.shingles)
    # files of rows that repeat a sketch are far smaller than the rows: no broadcast by file size
    rows = rows.withColumnRenamed("shingles", "held").hint("merge").join(flagged.distinct(), ["node", "s"])
    light = rows.where(F.col("held") <= rule.heavy // 8).hint("merge").join(full, "s")
    links = _by_bucket(light.drop("held")).mapInPandas(_unite(rule), "a long, b long")
    large = rows.where(F.col("held") > rule.heavy // 8)
    if not large.isEmpty():
        pairs = _by_bucket(large.drop("held")).mapInPandas(_pairs(rule), "a long, b long").distinct()
        links = links.unionByName(_true_links(pairs, full, rule))
    return links


def link_groups(docs: DataFrame, sets: DataFrame, first: DataFrame, rest: Callable, split: Callable,
                rule: Rule) -> DataFrame:
    """(child, parent): every linked set but the smallest ``s`` of its group, and that one.

    ``first``: (s, node) rows of the first buckets; ``rest(sets)``: (s, band, node, group,
    size) rows of all buckets of sets with a ``group``; ``split(rows, depth)``: such rows
    in finer buckets.
    """
    links = _first_links(docs, sets, first, rule)
    tree = components(links.select(F.col("b").alias("child"), F.col("a").alias("parent")), "links-groups")
    grouped = staged(sets.join(tree.withColumnRenamed("child", "s"), "s", "left").select(
        *sets.columns, F.coalesce("parent", "s").alias("group")), "links-grouped")
    other = _other_links(docs, grouped, rest(grouped), split, rule)
    every = links.unionByName(other).select(F.col("b").alias("child"), F.col("a").alias("parent"))
    return components(every, "links-components")
