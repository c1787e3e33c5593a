"""Content-defined chunks with memoised boundary summaries.

A rolling hash of the last ``SPAN`` bytes chooses the chunk ends, so a passage
that occurs in many texts is cut into the same chunks wherever it stands.  A
chunk's *summary* tells what it adds to a text's count of units:

* ``starts``: units that start in the chunk, if a text began with it,
* ``opens``: whether its first byte would go on with a unit that was open before,
* ``closes``: whether it ends within such a unit.

Summaries combine from left to right: a chunk that opens where its predecessor
closes starts one unit less.  Units are code points (a start is any byte that is
no UTF-8 continuation byte) or words (runs of bytes other than ASCII white space).

A cache holds summaries by content hash together with the chunk's bytes; a hit
counts only if the bytes are equal.  The cache is bounded by bytes and starts
anew when full, so a worker's memory does not grow with what it has read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import xxhash

SPAN = 16
LEAST, MEAN, MOST = 256, 1024, 8192
CACHE_BYTES = 16 << 20

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], dtype=np.uint32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def rolling_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``SPAN`` bytes up to every position: each byte's value, shifted by its distance."""
    h = _GEAR[raw]
    width = 1
    while width < SPAN:
        older = h[:-width] << np.uint32(width)
        h[width:] += older
        width *= 2
    return h


def chunk_ends(raw: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks of one text, the last one at its end.

    ``least`` is at least ``SPAN``, so what stands before a chunk never moves its end.
    """
    size, ends, start = len(raw), [], 0
    places = np.flatnonzero(rolling_hashes(raw) % np.uint32(mean) == 0) + 1
    for place in places.tolist():
        while place - start > most:
            start += most
            ends.append(start)
        if place - start >= least and place < size:
            start = place
            ends.append(start)
    while size - start > most:
        start += most
        ends.append(start)
    if size > start:
        ends.append(size)
    return ends


def _char_starts(raw: np.ndarray) -> np.ndarray:
    return (raw & 0xC0) != 0x80


def _word_starts(raw: np.ndarray) -> np.ndarray:
    inside = ~_SPACE[raw]
    inside[1:] &= _SPACE[raw[:-1]]
    return inside


def char_summary(chunk: bytes) -> tuple[int, bool, bool]:
    raw = np.frombuffer(chunk, dtype=np.uint8)
    return int(np.count_nonzero(_char_starts(raw))), False, False


def word_summary(chunk: bytes) -> tuple[int, bool, bool]:
    raw = np.frombuffer(chunk, dtype=np.uint8)
    return int(np.count_nonzero(_word_starts(raw))), not _SPACE[raw[0]], not _SPACE[raw[-1]]


UNITS = {"chars": (char_summary, _char_starts), "words": (word_summary, _word_starts)}


class SummaryCache:
    """Summaries of chunks by content, at most ``capacity`` bytes of chunks at a time."""

    def __init__(self, unit: str = "chars", capacity: int = CACHE_BYTES):
        self.summarise, self.starts = UNITS[unit]
        self.capacity = capacity
        self.held: dict[int, tuple[bytes, tuple[int, bool, bool]]] = {}
        self.size = self.hits = self.misses = 0

    def summary(self, chunk: bytes) -> tuple[int, bool, bool]:
        key = xxhash.xxh3_64_intdigest(chunk)
        found = self.held.get(key)
        if found is not None and found[0] == chunk:
            self.hits += 1
            return found[1]
        self.misses += 1
        made = self.summarise(chunk)
        if self.size + len(chunk) > self.capacity:
            self.held.clear()
            self.size = 0
        if found is None or key not in self.held:
            self.size += len(chunk)
            self.held[key] = (chunk, made)
        return made


class CutText:
    """One text as chunks: its number of units, and the byte where a unit starts."""

    def __init__(self, data: bytes, cache: SummaryCache):
        self.raw, self.cache = np.frombuffer(data, dtype=np.uint8), cache
        self.begins, self.before, self.opened = [], [], []
        count, start, inside = 0, 0, False
        for end in chunk_ends(self.raw):
            starts, opens, closes = cache.summary(data[start:end])
            joined = inside and opens
            self.begins.append(start)
            self.before.append(count)       # units that started in the chunks before
            self.opened.append(joined)
            count += starts - joined
            start, inside = end, closes
        self.n = count

    def offset(self, k: int) -> int:
        """Byte where unit ``k`` starts, counted from 0; the text's end for k = n."""
        if k <= 0:
            return 0
        if k >= self.n:
            return len(self.raw)
        at = bisect_right(self.before, k) - 1
        end = self.begins[at + 1] if at + 1 < len(self.begins) else len(self.raw)
        places = np.flatnonzero(self.cache.starts(self.raw[self.begins[at]:end]))
        return self.begins[at] + int(places[k - self.before[at] + self.opened[at]])
