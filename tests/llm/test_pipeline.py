import random

import pytest

import corpus_pipeline as p
from sitetally.llm import jaccard_join, pii

from . import cases

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = cases.prose(30, 200)


def rows():
    out = [(i, cases.prose(120, 210 + i)) for i in range(12)]
    out += [(20, out[0][1]), (21, out[0][1] + " tail"), (22, out[1][1]), (22, out[1][1])]
    out += [(30, cases.prose(60, 230) + " " + ITEM), (31, cases.prose(70, 231) + " write to ann@mail.example.com now"),
            (40, "too short"), (41, "same words again " * 40), (42, None), (43, "")]
    random.Random(1).shuffle(out)
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows()], COLUMNS)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def staged(spark, sf_dir, upto):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in p.STAGES[:upto]:
        docs = stage(spark, docs, sf_dir)
    return docs


def test_stage_order_and_columns(spark, sf_dir):
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    for upto in range(5):
        assert staged(spark, sf_dir, upto).columns == [c.split()[0] for c in COLUMNS.split(", ")]


def test_every_stage_decides(spark, sf_dir):
    ids = lambda n: sorted(r.doc_id for r in staged(spark, sf_dir, n).collect())
    good = ids(1)
    assert good == [*range(12), 20, 21, 22, 22, 30, 31]
    assert ids(2) == [*range(12), 30, 31]
    assert ids(3) == [*range(12), 31]
    clean = {r.doc_id: r for r in staged(spark, sf_dir, 4).collect()}
    assert sorted(clean) == ids(3)
    assert "write to [EMAIL] now" in clean[31].text and clean[31].n_chars == len(clean[31].text)
    assert clean[3].text == dict(rows())[3]


def test_run_packs_what_is_left(spark, sf_dir):
    pieces = p.run(spark, sf_dir).collect()
    assert {r.doc_id for r in pieces} == {*range(12), 31}
    by_doc = {}
    for r in pieces:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
        assert r.doc_tokens >= r.length
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in pieces)


def test_extra_and_clashing_columns(spark, sf_dir):
    docs = cases.documents(spark, rows())
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == cases.documents(spark, []).columns
    assert p.packing(spark, docs, sf_dir).count() > 0


def test_empty_documents(spark, sf_dir):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e
    names = [n for n in e.queries() if n == "pipeline" or n.startswith("op")]
    assert sorted(names) == sorted(["pipeline", *(n for n in names if n.startswith("op"))]) and len(names) == 14
    assert {n[2:].split("_")[0] for n in names if n != "pipeline"} == {str(k) for k in range(1, 14)}
    assert jaccard_join.SIMILARITY == 0.8 and pii.BASE_KINDS == ["email", "ip", "card", "phone"]
