import hashlib
import random
import re

from sitetally.llm import pii

from . import cases

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in hit.split(".")),
            "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    spans = [(m.start(), n, m.end(), kind) for n, (kind, p) in enumerate(PATTERNS)
             for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]


ROWS = [(20, "mail a.b+c@x-y.example.com_d@e.fr. é a@b a@.c x@y..z q@r.s.t, @ @@ 1@2.3"),
        (21, "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3.1234 9.9.9.9"),
        (22, "4111 1111 1111 1111, 4111-1111-1111-1112; 49927398716 and 4111  1111 1111 1111 12 34 - 5"),
        (23, "+1 (017) 555-7713 +12 +1-2-3 ++44 20 7946 0958. +999999999999999999 +1 017"),
        (24, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'), (25, "\x01\x03\x04 a\x03b@c\x03d.e.f 1\x011"),
        (26, "7" * 5000 + " " + "1 2 " * 4000 + "a." * 4000 + "@b" + ".c" * 4000), (27, "a" * 50_000)]


def spans_of(spark, rows, docs=None):
    docs = cases.documents(spark, rows) if docs is None else docs
    out = pii.detect(docs, pii.fit(docs), into="found")
    return [(r.doc_id, r.text, r.found) for r in out.select("doc_id", "text", "found").collect()]


def test_base_spans_against_python(spark):
    rng = random.Random(3)
    soup = [(100 + i, "".join(rng.choice("0123456789. -+()@ab\n") for _ in range(300))) for i in range(150)]
    rows = cases.texts() + ROWS + soup
    got = spans_of(spark, rows)
    assert len(got) == len(rows)
    for doc_id, text, found in got:
        mine = [f"{s.kind}:{s.start}:{s.stop}" for s in found if s.base]
        assert mine == brute(text), (doc_id, (text or "")[:60])


def test_model_adds_secrets_and_leaves_clean_text(spark):
    rng = random.Random(5)
    rows = [(i, cases.prose(30, i) + (f' token = "{rng.getrandbits(160):040x}" ' if i % 3 == 0 else " ")
             + cases.prose(10, i + 500)) for i in range(60)]
    rows += [(100 + i, f"{cases.prose(20, i)} version 1.2.3.{300 + i} of {cases.prose(20, i)}") for i in range(20)]
    for doc_id, _, found in spans_of(spark, rows):
        kinds = [s.kind for s in found]
        assert kinds == (["secret"] if doc_id < 60 and doc_id % 3 == 0 else []), doc_id


def test_em_finds_the_better_labeler():
    rng, counts = random.Random(1), {}
    for _ in range(4000):
        truth = 1 if rng.random() < 0.5 else -1
        votes = tuple(truth if rng.random() < p else -truth for p in (0.95, 0.9, 0.8, 0.55))
        counts[votes] = counts.get(votes, 0) + 1
    post, prior, rates = pii.expectation_maximisation(sorted(counts.items()))
    right = [rates[k][1][1] for k in range(4)]
    assert 0.4 < prior < 0.6 and right[0] > right[1] > right[2] > right[3]
    assert post[1, 1, 1, -1] > 0.95 and post[-1, -1, -1, 1] < 0.05


def test_redaction_and_native_plan(spark):
    docs = cases.documents(spark, ROWS + cases.texts())
    out = pii.redact(docs)
    assert out.columns == docs.columns
    by_id = {r.doc_id: r.text for r in out.collect()}
    assert by_id[22].startswith("[CARD], ") and "[IP]" in by_id[21] and by_id[1] is None
    assert by_id[23].startswith("[PHONE] +12")
    assert by_id[5] == dict(cases.texts())[5]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    empty = cases.documents(spark, [])
    assert pii.fit(empty) == {} and pii.redact(empty).count() == 0


def test_digest_columns(spark, tmp_path):
    cases.documents(spark, ROWS).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op8_pii(spark, str(tmp_path)).collect():
        base = brute(dict(ROWS)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.n_card == sum(x.startswith("card") for x in base)
        assert set(base) <= set(r.spans.split(",")) or not base
