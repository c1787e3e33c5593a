"""Overlap resolution and texts with very many detections."""

import random
import re
import time

from pyspark.sql import functions as F

from sitetally.llm import license_scan
from sitetally.llm.license_rules import rules

from . import cases


def greedy(text, table):
    """By strength, then place; against all that stay."""
    norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) + " "
    found = []
    for n, (label, priority, _, keyword, pattern) in enumerate(table):
        if " " + keyword in norm:
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", norm):
                start = norm[:m.start()].count(" ") - 1
                found.append((priority, start, -(start + m.group().count(" ") + 1), n, label))
    kept = []
    for d in sorted(found):
        if all(d[1] >= -k[2] or k[1] >= -d[2] for k in kept):
            kept.append(d)
    return sorted((s, -e, label) for _, s, e, _, label in kept)


def scanned(spark, rows, table):
    got = license_scan.scan(cases.documents(spark, rows), table=table).select("doc_id", "detections").collect()
    return {r.doc_id: [(d.start, d.stop, d.label) for d in r.detections] for r in got}


def rule(label, priority, words):
    return label, priority, 0.5, words.split()[0], words


def test_a_detection_is_lost_only_to_one_that_stays(spark):
    table = [rule("A", 50, "p q r s t u"), rule("B", 60, "q r"), rule("C", 10, "u v w"),
             rule("X", 50, "a b c"), rule("Y", 40, "c d e f"), rule("Z", 30, "f g h")]
    got = scanned(spark, [(1, "p q r s t u v w"), (2, "a b c d e f g h"), (3, "p q r s t u"), (4, "")], table)
    assert got == {1: [(1, 3, "B"), (5, 8, "C")], 2: [(0, 3, "X"), (5, 8, "Z")], 3: [(0, 6, "A")], 4: []}


def test_random_overlaps_across_steps(spark):
    rng = random.Random(3)
    table = [rule(f"r{k}", rng.choice([1, 2, 3]), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))))
             for k in range(25)]
    rows = [(k, " ".join(rng.choice("abcd" if k % 2 else "abc") for _ in range(rng.choice([3, 30, 400]))))
            for k in range(30)]
    got = scanned(spark, rows, table)
    assert all(got[k] == greedy(text, table) for k, text in rows)


def test_very_many_detections(spark):
    """300 KB with 50,000 base phrases and their detections, in time linear in them."""
    text, n = "cc by ", 50_000
    rows = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(text), F.lit(n)).alias("text"))
    began = time.time()
    row = license_scan.scan(rows, table=rules()).select(
        "n_words", "n_base", "first_word", "last_word", F.size("detections").alias("n")).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (2 * n, n, 0, 2 * n - 2)
    assert time.time() - began < 60 and row.n <= n
