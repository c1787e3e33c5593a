import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sitetally.llm import ranked_search as rs

from . import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counted = [(i, plain_terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in counted), sum(len(t) for _, t in counted)
    df = Counter(x for _, t in counted for x in set(t))
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, found in counted:
            tf, n, score = Counter(found), len(found), 0
            for x in plain_terms(text):
                if tf[x]:
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    score += w * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ITEMS = [(0, "The and of thn The"), (1, None), (2, ""), (3, "... !!"), (4, "absentword"), (5, cases.prose(150, 1)),
         (6, "ÊTRE où NAÏVE 日本語のテキスト"), (6, "one"), (None, "erin hean the"), (7, " ".join(cases.texts()[8][1].split()[:300])),
         (0, "The and of thn The"), (8, cases.texts()[8][1])]


@pytest.mark.parametrize("setting", ["whole", "small blocks", "groups"])
def test_equals_brute_force(spark, setting):
    rng = random.Random(4)
    rows = cases.texts() + [(20 + i, cases.prose(rng.randrange(1, 90), 40 + i)) for i in range(120)]
    rows += [(200 + i, cases.prose(30, 41)) for i in range(30)]            # equal scores
    rows += [(300, "THE the The and AND x_y the-the"), (301, "a\x00b\x7fc")]
    docs = cases.documents(spark, rows)
    if setting == "small blocks":
        docs = docs.repartition(3)
    got = rs.search(docs, bench(spark, ITEMS), group_bytes=200 if setting == "groups" else rs.GROUP_BYTES,
                    block_docs=16 if setting == "small blocks" else rs.BLOCK_DOCS)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == brute(rows, ITEMS)


def test_fewer_documents_and_other_k(spark):
    rows = [(1, "alpha beta"), (2, "beta"), (3, "gamma"), (None, "beta")]
    items = [(1, "beta alpha alpha"), (2, "delta")]
    for k in (1, 2, 10):
        assert rows_of(rs.search(cases.documents(spark, rows), bench(spark, items), k=k)) == brute(rows, items, k)


def test_empty_tables(spark):
    docs, none = cases.documents(spark), cases.documents(spark, [])
    for d, items in ((none, ITEMS), (docs, []), (docs, [(1, None)]), (cases.documents(spark, [(1, None)]), ITEMS)):
        assert rs.search(d, bench(spark, items)).count() == 0


def test_masks_group_documents_and_stop_early(monkeypatch):
    rng = np.random.default_rng(2)
    n = 3000
    docs = [(i, "common " * int(rng.integers(1, 4)) + ("rare " if i % 500 == 0 else "") + f"w{i}") for i in range(n)]
    items = rs.Items([(0, 0, "common rare")])
    monkeypatch.setattr(rs, "EVALUATED_AT_ONCE", 1)

    class Sent:
        value = items
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t.encode() for _, t in docs])],
                                       names=["id", "text"])
    row = next(rs._make_blocks(Sent)([batch])).to_pylist()[0]
    weights = np.array([0, *(rs.weight(n, c) for c in row["df"])], dtype=np.int64)
    block = rs.Block(row, weights, n, row["n_terms"])
    evaluated = []
    real = rs.Block.scores
    monkeypatch.setattr(rs.Block, "scores", lambda self, d, *a: evaluated.append(len(d)) or real(self, d, *a))
    found = block.best(*items.items[0][2:], 5)
    assert len(block.groups(np.arange(2), np.ones(2, int))[2]) == 2 and sum(evaluated) == 6      # only the mask with both terms
    assert sorted((-s, docs[p][0]) for p, s in found) == [(-r[3], r[2]) for r in sorted(
        brute(docs, [(0, "common rare")], 5), key=lambda r: r[1])]


def test_length_factor_beyond_64_bits():
    n = np.array([1, 10**9], dtype=np.int64)
    assert rs.length_factors(n, 10**12, 10**14).tolist() == [25 + 75 * 10**12 // 10**14, 25 + 75 * 10**21 // 10**14]
