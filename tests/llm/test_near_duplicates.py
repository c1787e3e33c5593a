import random
import re

import numpy as np
import pytest

from sitetally.llm import near_duplicates as nd
from sitetally.llm import superminhash as sm

from . import cases

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def brute(rows, percent=85):
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, x in enumerate(sets):
        holders.setdefault(x, []).append(k)
    kinds = [x for x in holders if x]
    for a in range(len(kinds)):
        for b in range(a + 1, len(kinds)):
            x, y = kinds[a], kinds[b]
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[find(holders[y][0])] = find(holders[x][0])
    first = {k: holders[x][0] if x else k for x in holders for k in holders[x]}
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            top = find(first[k])
            least[top] = min(i, least.get(top, i))
    out = []
    for k, (i, _) in enumerate(rows):
        group = least.get(find(first[k])) if sets[k] else i
        out.append((i, len(sets[k]), group, i == group))
    return sorted(out, key=str)


def got(spark, rows, **options):
    return sorted(map(tuple, nd.group_near_duplicates(cases.documents(spark, rows), **options).collect()), key=str)


def edited(text, places, seed):
    words, rng = text.split(), random.Random(seed)
    for _ in range(places):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_awkward_rows(spark):
    rows = cases.texts() + [(60, "ONE"), (61, "one"), (62, "one two"), (63, "ONE\x0btwo"), (64, "É e"), (65, "é e"),
                            (66, "a\x1cb"), (None, "no id here"), (None, "no ID  here")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def crowd():
    """Groups larger than a small bucket, chains, and a passage that many documents share."""
    rng, rows = random.Random(7), []
    passage = cases.prose(60, 70)
    for i in range(60):
        rows.append((i, passage + " " + cases.prose(rng.randrange(5, 60), 100 + i)))
    base = cases.prose(150, 71)
    rows += [(100 + i, edited(base, rng.randrange(0, 8), i)) for i in range(90)]
    text = cases.prose(120, 72)
    for i in range(15):
        rows.append((200 + i, text))
        text = edited(text, 2, 300 + i)
    rows += [(300 + i, passage + " " + edited(cases.prose(15, 73), 1, i)) for i in range(20)]
    rows += [(400 + i, base) for i in range(5)] + [(500, base.upper())]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"small": 4}, {"heavy": 8 * 200}, {"percent": 90, "width": 2}])
def test_groups_equal_brute_force(spark, options):
    rows = crowd()
    if "width" in options:
        full = got(spark, rows, **options)
        assert len({r[2] for r in full}) > len({r[2] for r in brute(rows, 85)}) and len(full) == len(rows)
    else:
        assert got(spark, rows, **options) == brute(rows)


def test_two_crowds_just_below_the_bound(spark):
    """Groups whose members come near those of the other, without a link between them."""
    base = cases.prose(200, 80)
    other = edited(base, 7, 81)
    rows = [(i, edited(base, 1, i)) for i in range(30)] + [(100 + i, edited(other, 1, 200 + i)) for i in range(30)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, small=8) == brute(rows)


def slow_signature(x, slots):
    """The definition: every element's whole permutation, one swap after the other."""
    best = [(slots, 0)] * slots
    for e in x:
        order = list(range(slots))
        for level in range(slots):
            place, value = sm._draw(np.array([e], dtype=np.uint64), level, slots)
            order[level], order[int(place[0])] = order[int(place[0])], order[level]
            best[order[level]] = min(best[order[level]], (level, int(value[0])))
    return [v for _, v in best]


@pytest.mark.parametrize("slots", [5, 40])
def test_signature_equals_its_definition(slots):
    rng = np.random.default_rng(slots)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 3, 10, 60, 300)]
    assert sm.signatures(sets, slots).tolist() == [slow_signature(x, slots) for x in sets]


def test_signature_of_a_very_large_set(monkeypatch):
    x = np.random.default_rng(1).integers(0, 1 << 63, 30_000).astype(np.uint64)
    whole = sm.signatures([x[:10], x, x[:20]])
    monkeypatch.setattr(sm, "ELEMENTS_AT_ONCE", 4096)
    assert (sm.signatures([x[:10], x, x[:20]]) == whole).all()


def test_estimates_vary_less_than_independent_hashes():
    rng, errors = np.random.default_rng(3), []
    for _ in range(150):
        a = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        b = np.concatenate((a[8:], rng.integers(0, 1 << 63, 8).astype(np.uint64)))
        one, two = sm.signatures([a, b])
        errors.append((one == two).mean() - 92 / 108)
    independent = (92 / 108 * 16 / 108 / sm.SLOTS) ** 0.5
    assert abs(np.mean(errors)) < 0.005 and np.std(errors) < 0.9 * independent
