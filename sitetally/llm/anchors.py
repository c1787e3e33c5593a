"""Content-chosen anchors: the one position that speaks for a window of bytes.

Every window of ``length`` bytes is spoken for by the position of its smallest
``GRAM``-byte hash, the leftmost of equal ones.  That choice depends on the
window's bytes alone, so equal windows, wherever they start, have the same
anchor hash at the same place in them.  The windows of one anchor position are
neighbours; the bytes that they cover are its *context*.
"""

from __future__ import annotations

import numpy as np
import xxhash

GRAM = 32
_CHUNK = 1 << 16                    # windows handled at once; positions in a chunk fit 17 bits
_POSITION_BITS = np.uint64(17)
_MASK = np.uint64((1 << 17) - 1)

_B = 0x9E3779B97F4A7C15             # odd, so it has an inverse modulo 2**64
_B_INVERSE = pow(_B, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE_VALUES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)
_SPAN = _CHUNK + (1 << 12)
_UP, _DOWN = _powers(_B, _SPAN), _powers(_B_INVERSE, _SPAN)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes, by which any stretch is hashed."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _UP[:len(data)], out=sums[1:])
    return sums


def gram_hashes(sums: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every run of ``gram`` bytes, scrambled."""
    h = (sums[gram:] - sums[:-gram]) * _DOWN[:len(sums) - gram]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by running minima of blocks of ``width``."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


SCREENS = 4


def _screens(sums: np.ndarray, first: np.ndarray, end: np.ndarray, place: np.ndarray,
             length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``SCREENS`` stretches around each anchor, a column each, and where a
    stretch leaves its context (no hash).

    A window that starts ``a`` bytes left of the anchor covers the stretch number
    a // step, counted from the one that starts at the anchor.  So two contexts
    share a window only if they share one of their stretches.  ``sums`` are the prefix
    sums of ``gram_hashes``; equal stretches of different bytes only cost work.
    """
    step = (length - GRAM) // SCREENS
    size = GRAM + (SCREENS - 1) * step
    at = place[:, None] - step * np.arange(SCREENS)
    outside = (at < first[:, None]) | (at + size > end[:, None])
    at = np.where(outside, 0, at)
    h = (sums[np.where(outside, 0, at + size)] - sums[at]) * _DOWN[at]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32), outside


def screened_anchors(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """First window, windows, anchor hash, anchor position, screens and screens outside
    of every anchor, in order."""
    raw = np.frombuffer(data, dtype=np.uint8)
    firsts, counts, keys, places, screens, outside = [], [], [], [], [], []
    for start in range(0, len(raw) - length + 1, _CHUNK):
        part = raw[start:start + _CHUNK + length - 1]
        sums = prefix_sums(part)
        h = gram_hashes(sums)
        h = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
        least = sliding_min(h, length - GRAM + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        firsts.append(first + start)
        counts.append(np.diff(np.append(first, len(least))))
        keys.append((least[first] >> _POSITION_BITS).astype(np.int64))
        place = (least[first] & _MASK).astype(np.int64)
        places.append(place + start)
        own, out = _screens(sums, first, first + counts[-1] + length - 1, place, length)
        screens.append(own)
        outside.append(out)
    if not firsts:
        empty, none = np.empty(0, dtype=np.int64), np.empty((0, SCREENS), dtype=np.int32)
        return empty, empty, empty, empty, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in (firsts, counts, keys, places, screens, outside))


def anchors(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor hash, anchor position) of every anchor, in order."""
    return screened_anchors(data, length)[:4]

