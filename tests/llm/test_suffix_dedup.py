import random
import subprocess
import sys
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from sitetally.llm import anchors as anc
from sitetally.llm import induced_sort as ind
from sitetally.llm import suffix_dedup as sd
from sitetally.llm.induced_sort import RunHeap, Scratch, common_prefixes, eight_bytes, repeated_starts

from . import cases


def windows(strings, cap):
    return Counter(s[i:i + cap] for s in strings for i in range(len(s) - cap + 1))


def mask_text(strings):
    return np.concatenate([np.zeros(1, np.uint8)] + [
        np.append(np.frombuffer(s, np.uint8) + 1, 0).astype(np.uint8) for s in strings])


@pytest.mark.parametrize("seed", range(6))
def test_induced_sort_against_counting(seed, tmp_path):
    """In memory, and with queues and heaps of a few tuples on disk and deep recursion."""
    rng = random.Random(seed)
    for _ in range(25):
        letters, cap = rng.choice([1, 2, 3, 26]), rng.choice([1, 2, 3, 5, 8, 17])
        strings = [bytes(97 + rng.randrange(letters) for _ in range(rng.randrange(60)))
                   for _ in range(rng.randrange(1, 8))]
        strings.append(strings[0][:rng.randrange(1, 30)] + strings[-1])
        count = windows(strings, cap)
        want = [False]
        for s in strings:
            want += [i + cap <= len(s) and count[s[i:i + cap]] > 1 for i in range(len(s))] + [False]
        scratch = Scratch(f"file://{tmp_path}/q")
        for limits in ({}, {"base_names": 4, "queue_items": rng.choice([3, 40])}):
            assert repeated_starts(mask_text(strings), cap, scratch, **limits).tolist() == want
        scratch.close()


def test_heap_spills_and_keeps_order(tmp_path):
    rng = random.Random(1)
    scratch, items = Scratch(f"file://{tmp_path}/q"), [(rng.randrange(50), i, i * 3) for i in range(500)]
    heap, out = RunHeap(scratch, 20), []
    for item in items:
        heap.push(item)
    while (item := heap.pop()) is not None:
        out.append(tuple(item))
    scratch.close()
    assert out == sorted(items) and heap.runs > 10 and not list(tmp_path.glob("q/*"))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 900, dtype=np.uint8).tobytes()
    texts = [rng.integers(97, 123, k, dtype=np.uint8).tobytes() + shared + b"x" * k for k in (0, 13, 70_000)]
    texts += [b"ab" * 2000]
    seen = {}
    for text in texts:
        first, n, key, _ = anc.anchors(text, 400)
        assert first.tolist() == [0, *np.cumsum(n)[:-1].tolist()] and int(n.sum()) == len(text) - 399
        for a, c, k in zip(first.tolist(), n.tolist(), key.tolist()):
            for s in range(a, a + c, 7):
                assert seen.setdefault(text[s:s + 400], k) == k


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count, out = windows(data, length), []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        out.append((i, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes", [8 << 20, 5000])
def test_removal_against_counting(spark, shard_bytes):
    passage = cases.prose(90, 90)
    rows = cases.texts() + [(50 + i, f"{cases.prose(12 + i, 91 + i)} {passage} {cases.prose(30, 120 + i)}")
                            for i in range(12)]
    rows += [(70, passage[:399]), (71, passage[:400]), (72, "ab" * 600), (73, "é" * 300 + passage[40:600]),
             (74, passage + passage)]
    got = sd.remove_repeats(cases.documents(spark, rows), shard_bytes=shard_bytes).collect()
    assert sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), key=str) == \
        brute(rows, 400)


def test_common_prefixes_against_bytes():
    """Over more places than are compared at once, to the separator and to the cap."""
    rng = random.Random(4)
    core = bytes(rng.choice(b"ab") for _ in range(90))
    strings = [core[:rng.randrange(90)] + bytes(rng.choice(b"ab\xfe") for _ in range(rng.randrange(4)))
               for _ in range(60)] + [b"", b"a"]
    text = mask_text(strings)
    raw, stop = text.tobytes(), {}
    for i in range(len(raw) - 1, -1, -1):
        stop[i] = i if raw[i] == 0 else stop[i + 1]
    room = np.array([stop[i] - i for i in range(len(raw))], dtype=np.int32)
    a, b = (np.array([rng.randrange(len(raw)) for _ in range(20_000)], dtype=np.int32) for _ in range(2))
    for cap in (1, 7, 8, 9, 64, 400):
        want = []
        for x, y in zip(a.tolist(), b.tolist()):
            n = 0
            while n < min(cap, room[x], room[y]) and raw[x + n] == raw[y + n]:
                n += 1
            want.append(n)
        assert common_prefixes(eight_bytes(text), room, a, b, cap).tolist() == want


def test_ranks_take_few_bytes_a_key():
    keys = np.random.default_rng(3).integers(0, 100_000, 200_000)
    tracemalloc.start()
    try:
        ranks = ind._ranks(keys)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert ranks.tolist() == np.unique(keys, return_inverse=True)[1].tolist()
    assert peak < 24 * len(keys)


HELD = """
import numpy as np, sys
from sitetally.llm import suffix_dedup as sd
def held():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
list(sd._sort_shard(400, "")([]))
np.ones(24 << 20, dtype=np.uint8)       # a dropped one of 24 MB would raise the bound to that
before, kept = held(), []
for _ in range(20):
    large = np.ones(8 << 20, dtype=np.uint8)
    kept += [large, np.ones(100_000, dtype=np.uint8)]
kept = kept[1::2]
del large
print(held() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_dropped_arrays_go_back_to_the_system():
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True,
                         cwd=str(Path(sd.__file__).resolve().parents[2]))
    assert int(out.stdout) < 40


def test_no_frame_for_each_text(monkeypatch):
    """A batch's anchors and contexts come in few frames; a frame a text was most of the time."""
    texts = [cases.prose(90, 300 + i) for i in range(80)] + ["short"]
    batch = pd.DataFrame({"t": range(81), "id": [None] + [str(i) for i in range(80)], "text": texts})
    made, frame = [], pd.DataFrame
    monkeypatch.setattr(sd.pd, "DataFrame", lambda *a, **k: made.append(1) or frame(*a, **k))
    found = list(sd._find_anchors(400)([batch]))
    assert len(made) == len(found) == 1
    rows = found[0]
    for t, own in rows.groupby("t"):
        data = texts[t].encode()
        first, n, key, _, screens, outside = anc.screened_anchors(data, 400)
        assert own["first"].tolist() == first.tolist() and own["n"].tolist() == n.tolist()
        assert own["key"].tolist() == key.tolist()
        assert own["screen2"].isna().tolist() == outside[:, 2].tolist()
        assert set(own["id"]) == {batch["id"][t]}
    wanted = [[{"key": 1, "ctx": i, "copies": 1, "first": 3, "n": 5}] * 2 for i in range(81)]
    cut = list(sd._cut_contexts(400)([frame({"text": texts, "wanted": wanted})]))
    assert len(made) == 2 and len(cut) == 1
    assert cut[0]["bytes"].tolist() == [t.encode()[3:407] for t in texts for _ in range(2)]


def test_empty_table(spark):
    assert sd.remove_repeats(cases.documents(spark, [])).count() == 0
