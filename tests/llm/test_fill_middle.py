import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitetally.llm import chunks, fill_middle as fm

from . import cases

LETTERS = "abc é日🙂\n<PSM>"


def sample(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(LETTERS) for _ in range(n))


@pytest.mark.parametrize("unit", ["chars", "words"])
def test_counts_and_offsets_equal_a_plain_scan(unit):
    cache = chunks.SummaryCache(unit, capacity=20_000)
    shared = sample(6000, 1)
    texts = ["", "a", " ", "🙂", "x" * 40_000, " " * 9000, "日" * 9000, shared]
    texts += [sample(n, 10 + n) + shared + sample(n, 20 + n) for n in (3, 500, 3000)]
    for text in texts:
        data = text.encode()
        found = chunks.CutText(data, cache)
        if unit == "chars":
            starts = [len(text[:k].encode()) for k in range(0, len(text), 97)]
            got = [found.offset(k) for k in range(0, len(text), 97)]
            assert found.n == len(text)
        else:
            words = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
            starts = [0, *words[1:]]
            got = [found.offset(k) for k in range(len(words) or 1)]
            assert found.n == len(words)
        assert got == starts
        assert found.offset(found.n) == (len(data) if found.n else 0)
    assert cache.hits and cache.size <= 20_000


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    passage = rng.integers(32, 127, 40_000).astype(np.uint8)
    ends = []
    for lead in (0, 1, 777, 5000):
        raw = np.concatenate((rng.integers(32, 127, lead).astype(np.uint8), passage))
        ends.append({e - lead for e in chunks.chunk_ends(raw)})
        assert all(0 < b - a <= chunks.MOST for a, b in zip([0, *chunks.chunk_ends(raw)], chunks.chunk_ends(raw)))
    for other in ends[1:]:
        assert len(ends[0] & other) >= 0.8 * len(ends[0])


def test_cache_checks_content():
    cache = chunks.SummaryCache()
    key = chunks.xxhash.xxh3_64_intdigest("é".encode())
    cache.held[key] = (b"other", (99, False, False))
    assert cache.summary("é".encode())[0] == 1


def brute(doc_id, text):
    text, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}"), sha(text))
    return (doc_id, n, "psm", a, b - a, sha(f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_query_equals_brute_force(spark, tmp_path):
    rows = cases.texts() + [(100 + i, sample(random.Random(i).randrange(400), i)) for i in range(150)]
    rows += [(900, "a<P>b"), (901, "<<S"), (902, "<M>"), (903, "<S<M<P" * 40), (904, "é" * 300_000)]
    cases.documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in fm.op13_fill_in_middle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((brute(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_words_other_sentinels_and_kept_columns(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    docs = cases.documents(spark)
    out = fm.fill_in_middle(docs, unit="words", sentinels=marks, plain_from=100, spm_below=50, seed=7)
    assert out.columns == [*docs.columns, "fim"]
    back = out.select("text", fm.restored(F.col("fim.output"), F.col("fim.form"), marks).alias("back"),
                      "fim.*").collect()
    assert all(r.back == (r.text or "") for r in back)
    assert all(r.n == len((r.text or "").split()) for r in back)
    with pytest.raises(ValueError):
        fm.fill_in_middle(docs, into="Spans")
    assert fm.fill_in_middle(cases.documents(spark, [])).count() == 0
