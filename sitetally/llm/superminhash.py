"""SuperMinHash signatures: correlated permutations, filled level by level.

Every element draws, level after level, the next place of its own random
permutation of the signature's slots together with a random value (an incremental
Fisher-Yates shuffle seeded by the element's hash).  A slot keeps the smallest value
of the lowest level that reached it, so a slot that is filled at one level is final
after it.  Since the places of one element never repeat, a set's slots are spread
more evenly than by independent hashes, and estimates vary less.

Early stopping: a set is finished with the level that fills its last slot.  Sets
much larger than the signature end after a few levels; one element needs them all.

All sets of a batch go through the levels together.  For the first levels the few
swaps of an element are looked up; sets that need more get their permutation as a row.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

SLOTS = 320
LOOKED_UP = 6                   # levels whose swaps are looked up
ROWS_AT_ONCE = 1 << 16          # elements whose whole permutation is held at a time
ELEMENTS_AT_ONCE = 1 << 18

_SEEDS = mix(np.arange(1, 1 << 10, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _draw(x: np.ndarray, level: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(place to swap with, value) of every element at a level."""
    z = mix(x ^ _SEEDS[level])
    place = level + (((z >> np.uint64(32)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
    return place, mix(z)


class _Fill:
    """Slots of a batch of sets: values, what is filled, and how many are open per set."""

    def __init__(self, sets: int, slots: int):
        self.slots = slots
        self.value = np.full(sets * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.open = np.ones(sets * slots, dtype=bool)
        self.left = np.full(sets, slots, dtype=np.int64)

    def level(self, at: np.ndarray, value: np.ndarray):
        """Take in one level's draws: places ``at`` in the flat slots and their values."""
        use = self.open[at]
        at, value = at[use], value[use]
        np.minimum.at(self.value, at, value)
        new = np.unique(at)
        self.open[new] = False
        self.left -= np.bincount(new // self.slots, minlength=len(self.left))


def _looked_up(position, swaps, default):
    """Value at ``position`` after the swaps so far: the last one that wrote there."""
    out = default.copy()
    for place, moved in swaps:
        hit = place == position
        out[hit] = moved[hit]
    return out


def _levels(x: np.ndarray, owner: np.ndarray, fill: _Fill):
    slots, swaps, level = fill.slots, [], 0
    while len(x) and level < min(LOOKED_UP, slots):
        place, value = _draw(x, level, slots)
        slot = _looked_up(place, swaps, place)
        here = _looked_up(level, swaps, np.full(len(x), level, dtype=np.int64))
        fill.level(owner * slots + slot, value)
        swaps.append((place, here))
        level += 1
        going = fill.left[owner] > 0
        if not going.all():
            x, owner = x[going], owner[going]
            swaps = [(a[going], b[going]) for a, b in swaps]
    if not len(x) or level == slots:
        return
    # sets are whole in a block of rows: elements of one set are neighbours
    edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
    start = 0
    while start < len(edges) - 1:
        stop = max(start + 1, int(np.searchsorted(edges, edges[start] + ROWS_AT_ONCE, "right")) - 1)
        lo, hi = edges[start], edges[stop]
        _rows(x[lo:hi], owner[lo:hi], [(a[lo:hi], b[lo:hi]) for a, b in swaps], level, fill)
        start = stop


def _rows(x, owner, swaps, level, fill: _Fill):
    """The further levels, with every element's permutation as a row."""
    slots, row = fill.slots, np.arange(len(x))
    order = np.tile(np.arange(slots, dtype=np.uint16), (len(x), 1))
    for place, moved in swaps:
        order[row, place] = moved
    while len(row) and level < slots:
        place, value = _draw(x, level, slots)
        slot, here = order[row, place], order[row, level]
        order[row, place] = here
        fill.level(owner * slots + slot, value)
        level += 1
        going = fill.left[owner] > 0
        if not going.all():
            x, owner, row = x[going], owner[going], row[going]


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` 64-bit values per set of distinct 64-bit hashes; no set is empty."""
    fill = _Fill(len(sets), slots)
    start = 0
    while start < len(sets):
        stop, held = start, 0
        while stop < len(sets) and (stop == start or held + len(sets[stop]) <= ELEMENTS_AT_ONCE):
            held += len(sets[stop])
            stop += 1
        if held > ELEMENTS_AT_ONCE and stop == start + 1 and _one_level(sets[start], start, fill):
            start = stop
            continue
        sizes = [len(x) for x in sets[start:stop]]
        _levels(np.concatenate(sets[start:stop]), np.repeat(np.arange(start, stop), sizes), fill)
        start = stop
    return fill.value.reshape(len(sets), slots)


def _one_level(x: np.ndarray, number: int, fill: _Fill) -> bool:
    """Level 0 of a very large set, in parts; True if that filled every slot."""
    trial = _Fill(1, fill.slots)
    for at in range(0, len(x), ELEMENTS_AT_ONCE):
        place, value = _draw(x[at:at + ELEMENTS_AT_ONCE], 0, fill.slots)
        np.minimum.at(trial.value, place, value)
        trial.open[place] = False
    if trial.open.any():
        return False
    fill.value[number * fill.slots:(number + 1) * fill.slots] = trial.value
    fill.left[number] = 0
    return True
