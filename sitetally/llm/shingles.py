"""Hashed word shingles for Python workers.

Words of many texts are hashed together: a polynomial of their bytes modulo 2**64, as a
difference of prefix sums, scrambled with the length.  Nothing is kept between calls, so the
cost does not depend on how many different words there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

WIDTH = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)

LONGEST = 256               # bytes; longer words are hashed one by one (xxhash)
SPAN = 1 << 18              # bytes whose prefix sums are held at a time
_POINT = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _spaces(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_SPLIT_SPACE = _spaces(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")      # of str.split, as far as it is ASCII
_ASCII_SPACE = _spaces(" \t\n\r\x0b\x0c")                        # of bytes.split
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _powers(base: int) -> np.ndarray:
    out = np.full(SPAN, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """A value for each byte, and the powers of the polynomial's point and of its inverse."""
    if not _TABLES:
        values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
        _TABLES.extend((values, _powers(_POINT), _powers(pow(_POINT, -1, 1 << 64))))
    return _TABLES


def _lowered(text: str | None) -> bytes:
    """UTF-8 of the lower-cased text, words between ASCII white space."""
    if not text:
        return b""
    text = text.lower()
    if not text.isascii() and _WIDE_SPACE.search(text):
        text = " ".join(text.split())
    return text.encode("utf-8", "surrogatepass")


def _hashed(data: list[bytes], spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words each text has."""
    whole = b" ".join([*data, b""])
    buf = np.frombuffer(whole, dtype=np.uint8)
    edges = np.diff(spaces[buf].view(np.int8), prepend=np.int8(1))
    starts, stops = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    ends = np.cumsum([len(x) + 1 for x in data]) if data else np.empty(0, np.int64)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    values, powers, inverse = _tables()
    out, sums = np.empty(len(starts), dtype=np.uint64), np.zeros(min(SPAN, len(buf)) + 1, dtype=np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(stops, first + SPAN, "right")))
        if (size := int(stops[stop - 1]) - first) <= SPAN:
            np.cumsum(values[buf[first:first + size]] * powers[:size], out=sums[1:size + 1])
            low = starts[at:stop] - first
            out[at:stop] = (sums[stops[at:stop] - first] - sums[low]) * inverse[low]
        at = stop
    sizes = stops - starts
    out = mix(out + sizes.astype(np.uint64) * _BASE)
    for k in np.flatnonzero(sizes > LONGEST):
        out[k] = xxhash.xxh64_intdigest(whole[starts[k]:stops[k]])
    return out, counts


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased, white-space separated words."""
    return _hashed([_lowered(text)], _SPLIT_SPACE)[0]


def ascii_word_hashes(data: bytes) -> np.ndarray:
    """The same for UTF-8 bytes: only A-Z are lower-cased, only ASCII white space separates."""
    return _hashed([data.lower()], _ASCII_SPACE)[0]


def words_of_all(texts: Iterable[str | None]) -> list[np.ndarray]:
    """``word_hashes`` of every text."""
    hashes, counts = _hashed([_lowered(t) for t in texts], _SPLIT_SPACE)
    return np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []


def ascii_words_of_all(data: Iterable[bytes | None]) -> list[np.ndarray]:
    """``ascii_word_hashes`` of every text."""
    hashes, counts = _hashed([(x or b"").lower() for x in data], _ASCII_SPACE)
    return np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []


def in_groups(texts: list, most_texts: int = 1024, most_chars: int = 1 << 20) -> Iterator[list]:
    """Consecutive texts (str, bytes or None), cut so that a group has few texts and characters."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if k + 1 - start == most_texts or held >= most_chars:
            yield texts[start:k + 1]
            start, held = k + 1, 0
    if start < len(texts):
        yield texts[start:]


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once; sorts in place."""
    values.sort()
    if len(values) < 2:
        return values
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of ``width`` words; fewer words make one shingle of them all."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        out = out * _BASE + words[k:n - width + 1 + k]
    return mix(out + np.uint64(width))
