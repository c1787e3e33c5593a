from collections import Counter

import numpy as np
import pytest

from sitetally.llm import decontaminate as d
from sitetally.llm.shingles import shingle_hashes, word_hashes

from . import cases


def shingles(words):
    width = min(5, len(words))
    return Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) if words else Counter()


def brute(rows, items, similarity=0.8):
    found = {}
    for n, (_, text) in enumerate(rows):
        words = (text or "").lower().split()
        for item, said in items:
            want = (said or "").lower().split()
            if not want or not words:
                continue
            width, size = min(5, len(want)), min(len(want), len(words))
            mine = Counter(tuple(want[i:i + width]) for i in range(len(want) - width + 1))
            for s in range(len(words) - size + 1):
                part = words[s:s + size]
                w = min(width, len(words))
                seen = Counter(tuple(part[i:i + w]) for i in range(len(part) - w + 1))
                common = (seen & mine).total()
                value = common / (seen.total() + mine.total() - common)
                if value >= similarity and value > found.get((n, item), 0):
                    found[n, item] = value
    return found


ITEMS = [(1, cases.prose(30, 50)), (2, cases.prose(12, 51)), (3, "only three words"), (4, None), (5, ""),
         (6, cases.prose(30, 52)), (7, cases.prose(60, 53)), (8, "the the the the the the the the")]


def rows():
    item, long_item = ITEMS[0][1], ITEMS[6][1].split()
    changed = long_item[:]
    changed[3] = "changed"
    return cases.texts() + [
        (50, cases.prose(40, 60) + " " + item + " " + cases.prose(40, 61)), (51, item), (52, item.upper()),
        (53, cases.prose(9, 62) + " " + " ".join(changed)), (54, " ".join(long_item[:30])),
        (55, "x only three words y"), (56, " ".join(long_item[5:])), (57, "the " * 30), (58, ITEMS[1][1] + " " + item)]


def test_matches_brute_force(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (2048, 3):
        out = d.match(cases.documents(spark, rows()), bench, into="found", block_items=block).collect()
        by_text = {}
        for r in out:
            by_text[r.text] = {m.item_id: m.similarity for m in r.found}
        want = brute(rows(), ITEMS)
        for n, (_, text) in enumerate(rows()):
            assert by_text[text] == pytest.approx({i: v for (k, i), v in want.items() if k == n})
    clean = d.keep_clean(cases.documents(spark, rows()), bench)
    assert clean.columns == cases.documents(spark, []).columns
    dirty = {n for n, _ in brute(rows(), ITEMS)}
    assert clean.count() == len(rows()) - len(dirty)


def test_empty_benchmark_and_table(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = cases.documents(spark)
    assert d.keep_clean(docs, bench).count() == docs.count()
    full = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.match(cases.documents(spark, []), full, into="found").count() == 0


def test_index_finds_every_print_within_the_radius():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 2**63, 150, dtype=np.uint64)
    queries = np.concatenate([items ^ np.bitwise_or.reduce(
        [np.uint64(1) << rng.integers(0, 64, dtype=np.uint64) for _ in range(k)]) for k in range(1, 26)])
    index, chosen = d.HammingIndex(items), np.arange(0, 150, 2)
    q, i = index.within(queries, chosen)
    apart = np.bitwise_count(queries[:, None] ^ items[chosen])
    want = {(a, int(chosen[b])) for a, b in zip(*np.nonzero(apart <= d.RADIUS))}
    assert set(zip(q.tolist(), i.tolist())) == want


def test_radius_recall_at_the_threshold():
    """Windows that just reach the similarity lie within the radius."""
    import random
    rng, near, total = random.Random(4), 0, 0
    for seed in range(400):
        words = cases.prose(rng.randrange(20, 60), seed).split()
        other = words[:]
        other[rng.choice([0, 1, len(words) - 1])] = "changed"
        a, b = shingles(words), shingles(other)
        common = (a & b).total()
        if common / (a.total() + b.total() - common) < 0.8:
            continue
        prints = [d.fingerprints(d.signs(shingle_hashes(word_hashes(" ".join(w)))).sum(axis=0, dtype=np.int64)[None])
                  for w in (words, other)]
        total += 1
        near += int(np.bitwise_count(prints[0] ^ prints[1])[0] <= d.RADIUS)
    assert total > 100 and near >= 0.99 * total
