import json
import zlib

import numpy as np
import pytest

from sitetally.llm import packing, token_files, tokens

from . import cases


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = ["", "  two  spaces\n\n\tand tabs \r\n", "it's they'll we'd I'M", "12345 x1y2z3", "¼ ½ ² ß Æ × ÷",
       "Ελληνικά текст 日本語", "\x1c\x1d\x85  ", "<|endoftext|> stays text", "naïve Straße ÑANDÚ!!! $$$ ###",
       "a" * 500, "é combining", "🙂 emoji 🏳️‍🌈"]


def test_pieces_give_the_library_ids(library):
    enc = tokens.PieceEncoder(tokens.default_vocabulary(), capacity=50, longest_cached=8)
    for text in ODD + [t for _, t in cases.texts()]:
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == library(text), text[:40]


def test_frequent_pieces_outlive_a_full_cache(monkeypatch):
    """Pieces that come again stay when others fill the cache, and the bytes stay bounded."""
    monkeypatch.setattr(tokens, "CACHE_BYTES", 40_000)
    enc, asked = tokens.PieceEncoder(tokens.default_vocabulary()), []
    one = enc.cache.encode_one
    enc.cache.encode_one = lambda piece: asked.append(piece) or one(piece)
    for n in range(2000):
        enc.encode(f"same word{n}")
        held = len(enc.cache) + len(enc.cache.old)
        assert held * enc.cache.ENTRY <= 40_000
    assert asked.count("same") == 1


def test_dac_random_access():
    rng = np.random.default_rng(1)
    for ids in ([0], [255, 256, 65535, 65536, 2**32 - 1], rng.integers(0, 50_257, 5000), rng.integers(0, 256, 700)):
        ids = np.array(ids, dtype=np.uint32)
        view = token_files.DacView(*token_files.dac_encode(ids))
        assert [view.at(i) for i in range(len(ids))] == ids.tolist()
        for a, b in [(0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids))]:
            assert view.slice(a, b).tolist() == ids[a:b].tolist()


def test_token_files_round_trip(spark, library, tmp_path):
    docs = cases.documents(spark)
    path = str(tmp_path / "dac")
    token_files.write_token_files(docs, path, segment_tokens=300)
    got = token_files.read_documents(spark, path).collect()
    rows = sorted(cases.texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r[0] for r in rows]
    flat, start = [], 0
    for (doc_id, text), r in zip(rows, sorted(got, key=lambda r: r.start)):
        ids = library(text) + [0]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        flat += ids
        start += len(ids)
    spots = [0, 5, start // 2, start - 1]
    asked = spark.createDataFrame([(p,) for p in spots], "position long")
    assert {r.position: r.token_id for r in token_files.read_tokens(spark, path, asked).collect()} == \
        {p: flat[p] for p in spots}


def test_empty_tables(spark, tmp_path):
    empty = cases.documents(spark, [])
    token_files.write_token_files(empty, str(tmp_path / "dac"))
    assert token_files.read_documents(spark, str(tmp_path / "dac")).count() == 0
    assert packing.pack(empty).count() == 0


def test_packing_covers_every_id_once(spark, library):
    docs = cases.documents(spark).repartition(5)
    rows = packing.pack(docs, window=256, open_windows=3, fan_in=2).collect()
    want = sorted(np.array(library(t) + [1], "<u4").tobytes() for _, t in cases.texts())
    by_doc = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, bytes(r.ids)))
    whole = []
    for (doc_id, n), pieces in by_doc.items():
        copies = sum(length for _, length, _ in pieces) // n      # doc 11 is there twice, equal
        pieces.sort()
        if copies == 1:
            assert [s for s, _, _ in pieces] == [sum(x[1] for x in pieces[:i]) for i in range(len(pieces))]
            whole.append(b"".join(x[2] for x in pieces))
    assert all(w in want for w in whole) and len(whole) >= 13
    assert sum(r.length for r in rows) == sum(len(library(t)) + 1 for _, t in cases.texts())
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(x[1] for x in pieces[:i]) for i in range(len(pieces))]
    sizes = [sum(x[1] for x in p) for p in seqs.values()]
    assert max(sizes) <= 256 and sum(s < 256 for s in sizes) <= 3


def test_vocabulary_parameter_is_honoured(tmp_path, library):
    spec = json.load(open(tokens.default_vocabulary(), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "prefix.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    enc = tokens.PieceEncoder(str(path))
    assert not enc.by_piece
    assert enc.ids("word").tolist() == library(" word")
