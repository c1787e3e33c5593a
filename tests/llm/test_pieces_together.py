"""Token pieces cut and told apart together; candidates of personal data looked for once."""

import json
import random

import numpy as np
import pytest

from sitetally.llm import pii, tokens

from . import cases

PARTS = ["'", "'s", "'t", "'re", "'ve", "'ll", "'l", "'r", "'d", "'m", " ", "  ", "\n", "\t", "\r", "a", "s", "é", "É", "ɏ",
         "1", "23", ".", "!", '"', "word", "Ab", "x" * 40, " " * 40, "-" * 33, "×", "日", "\x00"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.PieceEncoder(tokens.default_vocabulary())


def mixed(n, seed, parts=PARTS):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_ids_of_many_texts_are_the_library_s(encoder):
    texts = mixed(1500, 1) + mixed(1500, 2, PARTS[:-3]) + [t for _, t in cases.texts()]
    got = encoder.encode_all(texts)
    assert len(got) == len(texts)
    for text, ids in zip(texts, got):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids if text else []
        assert ids.tolist() == want


def test_a_piece_is_looked_up_once_a_group(monkeypatch):
    """Many texts of few different pieces: the table sees each piece once."""
    own, seen = tokens.PieceEncoder(tokens.default_vocabulary()), []
    numbers = tokens._PieceTable.numbers
    monkeypatch.setattr(tokens._PieceTable, "numbers", lambda self, x: seen.append(len(x)) or numbers(self, x))
    texts = [" ".join(random.Random(k).choices(["one", "two", "three"], k=200)) for k in range(300)]
    got = own.encode_all(texts)
    assert sum(seen) <= 6
    assert all((a == own.ids(t)).all() for a, t in zip(got, texts))


def test_a_full_table_starts_anew(monkeypatch):
    own, texts = tokens.PieceEncoder(tokens.default_vocabulary()), [cases.prose(300, k) for k in range(12)]
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(tokens, "GROUP_CHARS", 1000)
    for text, ids in zip(texts * 2, own.encode_all(texts * 2)):
        assert (ids == own.ids(text)).all()
    assert own.table.size < 60_000


def test_vocabularies_whose_merges_do_not_follow_their_ids():
    with open(tokens.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    model["merges"] = model["merges"][:400]
    assert len(tokens.merge_ranks(spec)) == 656
    assert tokens.merge_ranks({"model": {**model, "merges": model["merges"][::-1]}}) is None
    assert tokens.merge_ranks({"model": {**model, "dropout": 0.1}}) is None
    # "abc" from "ab" and "c", though "bc" comes before "ab": merging by lowest id would take "a" and "bc"
    vocab = {c: n for n, c in enumerate(sorted(chr(tokens._byte_chars().get(b, b)) for b in range(256)))}
    merges = ["b c", "a b", "ab c"]
    odd = {"type": "BPE", "merges": merges, "vocab": vocab | {m.replace(" ", ""): 256 + n for n, m in enumerate(merges)}}
    assert tokens.merge_ranks({"model": odd}) is None
    assert np.array_equal([*tokens.merge_ranks({"model": odd | {"merges": merges[:2]}}).values()][-2:], [256, 257])


def test_candidates_are_looked_for_once(spark, monkeypatch):
    """``redact`` writes the candidates and reads them for the classifier and for the result."""
    made, staged, look = [], pii.staged, pii._with_candidates
    monkeypatch.setattr(pii, "staged", lambda df, name: made.append(name) or staged(df, name))
    monkeypatch.setattr(pii, "_with_candidates", lambda *x: made.append("looked") or look(*x))
    rows = [(k, f"{cases.prose(20, k)} write to a{k}@mail.example.com or call +1 212 555 01{k:02d}") for k in range(10)]
    docs = cases.documents(spark, rows + [(20, None), (21, "")])
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert made == ["looked", "pii-candidates"]
    assert all("[EMAIL]" in got[k] and "[PHONE]" in got[k] and "@" not in got[k] for k in range(10))
    assert got[20] is None and got[21] == ""
    assert pii.redact(docs).columns == docs.columns
