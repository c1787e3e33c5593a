"""External induced suffix sorting with common-prefix values, capped at a length.

Suffixes are bytes+1 with 0 as a separator; every separator counts as a symbol of
its own, ordered by place, so no common prefix crosses one.

1. Leftmost S suffixes (LMS) are sorted: their substrings get names, the string
   of names is sorted recursively.  A string of names that fits in memory
   (``base_names``) is the base case, sorted by doubling; a longer one is induced
   again, through a heap of suffix tuples that writes sorted runs to disk.
2. From them the L suffixes are induced upwards and from those the S suffixes
   downwards, through a priority queue of suffix tuples (position, common prefix)
   with one bucket per first byte.  Its buckets are appended and read in order, and
   go to disk when the queue holds more than ``queue_items`` tuples.
   An induced suffix's common prefix with the one before it is 1 more than the
   least common prefix between their parents.

Suffixes that agree on ``cap`` bytes may come in any order among themselves.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np

BASE_NAMES = 1 << 24
QUEUE_ITEMS = 1 << 25
BLOCK = 1 << 18                     # tuples handled at once
NEAR = 1 << 14                      # suffixes compared at once


class Scratch:
    """Files of one task, below a URI of any store; removed by ``close``."""

    def __init__(self, uri: str):
        from pyarrow import fs
        self.system, path = fs.FileSystem.from_uri(uri)
        self.path, self.made = f"{path.rstrip('/')}/{uuid.uuid4().hex}", False

    def write(self, name: str, array: np.ndarray) -> str:
        if not self.made:
            self.system.create_dir(self.path, recursive=True)
            self.made = True
        path = f"{self.path}/{name}"
        with self.system.open_output_stream(path) as out:
            out.write(np.ascontiguousarray(array).data)
        return path

    def blocks(self, path: str, dtype, items: int):
        dtype = np.dtype(dtype)
        with self.system.open_input_stream(path) as source:
            while raw := source.read(items * dtype.itemsize):
                yield np.frombuffer(raw, dtype=dtype)

    def close(self):
        if self.made:
            self.system.delete_dir(self.path)


def places(n: int) -> np.dtype:
    """The narrowest type that holds positions in ``n`` symbols."""
    return np.dtype(np.int32 if n < (1 << 31) - 16 else np.int64)


TUPLE = np.dtype([("pos", "<i8"), ("lcp", "<i4")])


class BucketQueue:
    """Monotone queue: a bucket's tuples come out in the order they went in."""

    def __init__(self, buckets: int, scratch: Scratch, most_items: int):
        self.scratch, self.most = scratch, most_items
        self.held = [[] for _ in range(buckets)]
        self.files = [[] for _ in range(buckets)]
        self.items = self.written = 0

    def append(self, bucket: int, pos: np.ndarray, lcp: np.ndarray):
        self.held[bucket].append((pos, lcp))
        self.items += len(pos)
        if self.items > self.most:
            self._spill()

    def _spill(self):
        for bucket, chunks in enumerate(self.held):
            if chunks:
                rows = np.empty(sum(len(p) for p, _ in chunks), dtype=TUPLE)
                rows["pos"] = np.concatenate([p for p, _ in chunks])
                rows["lcp"] = np.concatenate([x for _, x in chunks])
                self.files[bucket].append(self.scratch.write(f"bucket-{id(self)}-{self.written}", rows))
                self.written += 1
                self.held[bucket] = []
        self.items = 0

    def take(self, bucket: int):
        """Chunks in order; the bucket is empty afterwards, new ones may be appended meanwhile."""
        files, self.files[bucket] = self.files[bucket], []
        chunks, self.held[bucket] = self.held[bucket], []
        self.items -= sum(len(p) for p, _ in chunks)
        for path in files:
            for rows in self.scratch.blocks(path, TUPLE, self.most // 4 + 1):
                yield rows["pos"].copy(), rows["lcp"].copy()
        yield from _blocks(chunks)

    def filled(self, bucket: int) -> bool:
        return bool(self.files[bucket] or self.held[bucket])


def _blocks(chunks: list):
    """The tuples of ``chunks`` in order, some ``BLOCK`` at a time; ``chunks`` is used up."""
    chunks.reverse()
    own, size = [], 0
    while chunks:
        pos, lcp = chunks.pop()
        for at in range(0, len(pos), BLOCK):
            own.append((pos[at:at + BLOCK], lcp[at:at + BLOCK]))
            size += len(own[-1][0])
            if size >= BLOCK or (not chunks and at + BLOCK >= len(pos)):
                yield np.concatenate([p for p, _ in own]), np.concatenate([x for _, x in own])
                own, size = [], 0


class RunHeap:
    """Priority queue of (key, order, position); overflow becomes sorted runs on disk."""

    def __init__(self, scratch: Scratch, most_items: int):
        self.scratch, self.most, self.heap, self.runs, self.heads = scratch, most_items, [], 0, []

    def push(self, item: tuple[int, int, int]):
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            path = self.scratch.write(f"run-{id(self)}-{self.runs}", np.array(sorted(self.heap), dtype="<i8"))
            self.heap, self.runs = [], self.runs + 1
            rows = (tuple(r) for block in self.scratch.blocks(path, "<i8", 3 << 16)
                    for r in block.reshape(-1, 3).tolist())
            heapq.heappush(self.heads, (next(rows), self.runs, rows))

    def pop(self):
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run, rows = heapq.heappop(self.heads)
            following = next(rows, None)
            if following is not None:
                heapq.heappush(self.heads, (following, run, rows))
            return item
        return heapq.heappop(self.heap) if self.heap else None


def s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one.  The last is S."""
    n = len(text)
    grows = np.append(text[1:] > text[:-1], True)
    where = np.arange(n, dtype=places(n))
    where[:-1][text[1:] == text[:-1]] = n
    following = np.minimum.accumulate(where[::-1], out=where[::-1])[::-1]
    return grows[following]


def lms_positions(s_type: np.ndarray) -> np.ndarray:
    out = np.flatnonzero(s_type[1:] & ~s_type[:-1]).astype(places(len(s_type)))
    out += 1
    return out


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of integer keys."""
    order = np.argsort(keys).astype(places(len(keys)))
    ordered = keys[order]
    new = np.append(False, ordered[1:] != ordered[:-1])
    del ordered
    out = np.empty(len(keys), dtype=order.dtype)
    out[order] = np.cumsum(new, dtype=order.dtype)
    return out


def _names(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, unique_zero: bool) -> np.ndarray:
    """Ranks of LMS substrings, symbols compared with their types, in text order."""
    stop = np.concatenate((lms[1:], np.array([len(text) - 1], dtype=lms.dtype)))
    wider = np.uint16 if text.dtype == np.uint8 else np.int64
    symbols = np.zeros(len(text) + 8, dtype=wider)
    np.left_shift(text, 1, out=symbols[:len(text)], dtype=wider)
    symbols[:len(text)] |= s_type
    wide = int(symbols.max()) + 1
    per_key = max(1, min(7, int(40 / np.log2(wide + 1))))
    rank, at = np.zeros(len(lms), dtype=lms.dtype), 0
    open_ones = np.arange(len(lms), dtype=lms.dtype)
    while len(open_ones):
        rank = rank.astype(np.int64)
        rank *= wide ** per_key
        for own in np.array_split(open_ones, len(open_ones) // BLOCK + 1):
            key = np.zeros(len(own), dtype=np.int64)
            for k in range(per_key):
                place = np.minimum(lms[own] + at + k, len(text))
                key = key * wide + np.where(place <= stop[own], symbols[place], 0)
            rank[own] += key
        rank = _ranks(rank)
        at += per_key
        again = lms[open_ones] + at <= stop[open_ones]
        open_ones = open_ones[again]
    if unique_zero:
        zero = text[lms] == 0
        k = int(zero.sum())
        rank += k
        rank[zero] = np.arange(k)
    return rank


def _doubling(names: np.ndarray, cap: int) -> np.ndarray:
    """Order of the suffixes of ``names``, exact on their first ``cap`` names at least."""
    n = len(names)
    rank, h = _ranks(names), 1
    rank += 1
    while True:
        # only suffixes that still tie need a new rank
        count = np.bincount(rank).astype(rank.dtype)
        ties = np.flatnonzero(count[rank] > 1).astype(rank.dtype)
        if not len(ties) or h >= cap:
            return np.argsort(rank, kind="stable")
        following = np.where(ties + h < n, rank[np.minimum(ties + h, n - 1)], 0)
        # ranks leave room for their ties
        base = np.cumsum(count, dtype=rank.dtype)
        base -= count
        del count
        key = rank[ties].astype(np.int64)
        key *= n + 2
        key += following
        del following
        order = np.argsort(key)
        key = key[order]
        ties = ties[order]
        del order
        new = np.append(True, key[1:] != key[:-1])
        del key
        group = rank[ties]
        first_of_group = np.append(True, group[1:] != group[:-1])
        index = np.arange(len(ties), dtype=rank.dtype)
        spread = base[rank] + 1
        spread[ties] = (base[group] + 1 + np.maximum.accumulate(np.where(new, index, 0))
                        - np.maximum.accumulate(np.where(first_of_group, index, 0)))
        rank = spread
        h *= 2


def _heap_order(names: np.ndarray, cap: int, scratch: Scratch, base_names: int, heap_items: int) -> np.ndarray:
    """Suffix order of a string of names by recursion and induction through heaps."""
    n = len(names)
    # sentinel 0 at the end makes every suffix end
    text = np.append(names + 1, 0)
    s_type = s_types(text)
    lms = lms_positions(s_type)
    seeds = lms[_order(_names(text, s_type, lms, False), cap, scratch, base_names, heap_items)]
    chars, is_s = text.tolist(), s_type.tolist()
    out_l, heap, turn = [], RunHeap(scratch, heap_items), 0
    waiting = iter(seeds.tolist())
    seed = next(waiting, None)
    item = None
    while True:
        item = item or heap.pop()
        if item is None and seed is None:
            break
        if item is not None and (seed is None or item[0] <= chars[seed]):
            pos, item = item[2], None
            out_l.append(pos)
        else:
            pos, seed = seed, next(waiting, None)
            if item is not None:
                heap.push(item)
                item = None
        if pos and not is_s[pos - 1]:
            heap.push((chars[pos - 1], turn, pos - 1))
            turn += 1
    order, heap, turn = [], RunHeap(scratch, heap_items), 0
    waiting = reversed(out_l)
    large = next(waiting, None)
    while True:
        item = item or heap.pop()
        if item is None and large is None:
            break
        if item is not None and (large is None or -item[0] >= chars[large]):
            pos, item = item[2], None
        else:
            pos, large = large, next(waiting, None)
            if item is not None:
                heap.push(item)
                item = None
        order.append(pos)
        if pos and is_s[pos - 1]:
            heap.push((-chars[pos - 1], turn, pos - 1))
            turn += 1
    out = np.array(order[::-1], dtype=np.int64)
    return out[out < n]


def _order(names: np.ndarray, cap: int, scratch: Scratch, base_names: int, heap_items: int) -> np.ndarray:
    if int(names.max(initial=-1)) + 1 == len(names):
        return np.argsort(names)
    if len(names) <= max(base_names, 4):
        return _doubling(names, cap)
    return _heap_order(names, cap, scratch, base_names, heap_items)


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``text`` as one number, the first lowest; zeros follow the end."""
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8)))
    return np.ndarray(len(text) + 1, dtype="<u8", buffer=padded, strides=(1,))


def common_prefixes(words: np.ndarray, room: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of suffixes a[k] and b[k], at most ``cap`` and up to the next separator.

    ``words``: ``eight_bytes`` of the text.
    """
    out = np.empty(len(a), dtype=np.int32)
    # few suffixes at once, so that the bytes compared stay in the cache
    for k in range(0, len(a), NEAR):
        x, y = a[k:k + NEAR], b[k:k + NEAR]
        most = np.minimum(np.minimum(room[x], room[y]), cap)
        own = out[k:k + NEAR]
        own[:] = most
        left, done = np.flatnonzero(most), 0
        x, y, most = x[left], y[left], most[left]
        while len(left):
            differ = words[x] ^ words[y]
            unlike = np.flatnonzero(differ)
            bits = differ[unlike]
            bits &= ~bits + np.uint64(1)            # the lowest bit that differs
            n = (np.frexp(bits.astype(np.float64))[1] - 1) >> 3
            own[left[unlike]] = np.minimum(done + n, most[unlike])
            done += 8
            again = np.flatnonzero((differ == 0) & (most > done))
            left, x, y, most = left[again], x[again] + 8, y[again] + 8, most[again]
    return out


class _RangeMin:
    """Smallest of x[lo..hi] for many ranges: a sparse table of which one level, the
    minima of 2**k neighbours, is held at a time."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), dtype=self.x.dtype)
        level = (np.frexp((hi - lo + 1).astype(np.float64))[1] - 1).astype(np.int8)
        table = self.x
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                half = 1 << (k - 1)
                table = np.minimum(table[:-half], table[half:])
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << k) + 1])
        return out


class _Inducer:
    """Pushes the left neighbours of popped suffixes, with their common prefixes."""

    def __init__(self, text, chosen, queue, cap):
        self.text, self.chosen, self.queue, self.cap = text, chosen, queue, cap
        # least common prefix between a bucket's last parent and the last popped suffix
        self.since = np.full(257, -1, dtype=np.int64)

    def feed(self, pos: np.ndarray, lcp: np.ndarray):
        """``lcp``: common prefix of each popped suffix with the one popped before it."""
        before = pos - 1
        k = np.flatnonzero((pos > 0) & self.chosen[before])
        least = int(lcp.min())
        if not len(k):
            self.since = np.minimum(self.since, least)
            return
        target = self.text[before[k]]
        order = np.argsort(target, kind="stable")
        k, target = k[order], target[order].astype(np.int64)
        first = np.concatenate(([True], target[1:] != target[:-1]))
        lo = np.where(first, 0, np.concatenate(([0], k[:-1] + 1)))
        minimum = _RangeMin(lcp)
        value = minimum(lo, k)
        value[first] = np.minimum(value[first], self.since[target[first]])
        value = np.minimum(value + 1, self.cap)             # -1 (bucket is empty) becomes 0
        self.since = np.minimum(self.since, least)
        starts = np.flatnonzero(first)
        for a, b in zip(starts, np.append(starts[1:], len(k))):
            self.queue.append(int(target[a]), before[k[a:b]], value[a:b])
        last = np.append(starts[1:], len(k)) - 1
        rest = k[last] < len(pos) - 1
        self.since[target[last]] = self.cap
        if rest.any():
            at = last[rest]
            self.since[target[at]] = minimum(k[at] + 1, np.full(len(at), len(pos) - 1))


def repeated_starts(text: np.ndarray, cap: int, scratch: Scratch, base_names: int = BASE_NAMES,
                    queue_items: int = QUEUE_ITEMS) -> np.ndarray:
    """Mask of the suffixes that share ``cap`` bytes with another suffix.

    ``text``: uint8, bytes + 1, with a 0 before, between and after the strings.
    """
    n = len(text)
    s_type = s_types(text)
    zeros = np.flatnonzero(text == 0)
    room = np.repeat(zeros.astype(places(n)), np.diff(zeros, prepend=-1))
    room -= np.arange(n, dtype=places(n))
    lms = lms_positions(s_type)
    out = np.zeros(n, dtype=bool)
    if not len(lms):
        return out
    seeds = lms[_order(_names(text, s_type, lms, True), cap // 2 + 1, scratch, base_names, queue_items)]
    del lms
    seed_lcp = np.zeros(len(seeds), dtype=np.int32)
    words = eight_bytes(text)
    seed_lcp[1:] = common_prefixes(words, room, seeds[:-1], seeds[1:], cap)
    seed_bounds = np.searchsorted(text[seeds], np.arange(258))

    def between(a, b):
        return int(common_prefixes(words, room, np.array([a]), np.array([b]), cap)[0])

    # upwards: L suffixes, after each bucket its seeds
    queue = BucketQueue(257, scratch, queue_items)
    kept = BucketQueue(257, scratch, queue_items)        # L suffixes, for the way down
    inducer = _Inducer(text, ~s_type, queue, cap)
    for c in range(257):
        last, first_chunk = None, True
        while queue.filled(c):
            for pos, lcp in queue.take(c):
                if first_chunk:
                    lcp[0] = 0
                    first_chunk = False
                kept.append(c, pos, lcp)
                inducer.feed(pos, lcp)
                last = int(pos[-1])
        a, b = seed_bounds[c], seed_bounds[c + 1]
        if a < b:
            seed_lcp[a] = 0 if last is None else between(last, int(seeds[a]))
            for own in _blocks([(seeds[a:b], seed_lcp[a:b])]):
                inducer.feed(*own)

    # downwards: S suffixes, after each bucket its L suffixes; both from large to small
    del seeds, seed_lcp
    queue = BucketQueue(257, scratch, queue_items)
    inducer = _Inducer(text, s_type, queue, cap)
    for c in range(256, -1, -1):
        last, first_chunk = None, True
        if c == 0:
            break                   # separators share nothing
        while queue.filled(c):
            for pos, lcp in queue.take(c):
                if first_chunk:
                    lcp[0] = 0
                    first_chunk = False
                _mark(out, pos, lcp, last, cap)
                inducer.feed(pos, lcp)
                last = int(pos[-1])
        chunks = list(kept.take(c))
        carried = None              # common prefix with the next larger L suffix
        for pos, lcp in reversed(chunks):
            down = np.append(np.zeros(1, dtype=lcp.dtype), lcp[:0:-1])
            pos_down = pos[::-1]
            if carried is not None:
                down[0] = carried
            elif last is not None:
                down[0] = between(last, int(pos_down[0]))
            carried = int(lcp[0])
            _mark(out, pos_down, down, last, cap)
            inducer.feed(pos_down, down)
            last = int(pos_down[-1])
    return out


def _mark(out: np.ndarray, pos: np.ndarray, lcp: np.ndarray, last: int | None, cap: int):
    """Mark neighbours in suffix order that share ``cap`` bytes."""
    same = lcp >= cap
    out[pos[same]] = True
    out[pos[:-1][same[1:]]] = True
    if same[0] and last is not None:
        out[last] = True
