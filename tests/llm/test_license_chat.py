import re

from sitetally.llm import chat, license_scan
from sitetally.llm.license_rules import BASE, rules

from . import cases

LICENSES = [
    (30, "Released under the MIT License. All rights reserved, all rights reserved."),
    (31, "cc by cc by CC-BY 4.0 (https://creativecommons.org/licenses/by/4.0)"),
    (32, "SPDX-License-Identifier: GPL-3.0-or-later\nGNU General Public License version 3"),
    (33, "accc by ccc byx general public licenses General Public License"),
    (34, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
         "compliance with the License"),
    (35, "mit " * 300 + "bsd 3-clause license and zlib license"),
]


def brute(text, table):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                       (text or "").translate({c: c + 32 for c in range(65, 91)}))
    starts, base = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k:k + len(p)] == p:
                starts.append(k)
                base.add(label)
    norm, found = " " + " ".join(words) + " ", []
    for n, (label, priority, confidence, keyword, pattern) in enumerate(table):
        if " " + keyword in norm:
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", norm):
                s = norm[:m.start()].count(" ") - 1
                found.append((s, -(s + m.group().count(" ") + 1), priority, n, label, confidence))
    kept = []
    for x in sorted(found):
        if not kept or x[0] >= -kept[-1][1]:
            kept.append(x)
        elif x[2] < kept[-1][2]:
            kept[-1] = x
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {x[4] for x in kept})), max((x[5] for x in kept), default=0.0))


def test_license_scan_against_brute_force(spark):
    rows = cases.texts() + LICENSES
    got = license_scan.scan(cases.documents(spark, rows)).drop("detections").collect()
    assert len(got) == len(rows)
    want = sorted(((i, *brute(t, rules())) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_rules_are_many_and_scan_stays_native(spark):
    assert len(rules()) > 200 and all(re.compile(p) for *_, p in rules())
    plan = license_scan.scan(cases.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert license_scan.scan(cases.documents(spark, [])).count() == 0


TALK = [(1, 0, "user", "hi"), (1, 1, "bob", "yo"), (1, 2, "user", None), (1, None, None, "first"),
        (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "amy", "b"), (None, 3, "x", "lost"), (3, 0, "user", "")]


def rendered(rows, speaker):
    text, mask = "", []
    for _, role, said in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        text += "<|assistant|>\n" if role == speaker else f"<|user name={role}|>\n"
        if role == speaker:
            mask.append(f"{len(text)}-{len(text) + len(said) + 7}")
        text += said + "<|end|>\n"
    return text, ",".join(mask)


def _talks():
    talks = {}
    for conv, turn, role, said in TALK:
        talks.setdefault(conv, []).append((turn, role or "unknown", said or ""))
    return talks


SCHEMA = "conv_id long, turn int, role string, text string, part int, speakers string"


def test_rotation(spark):
    df = spark.createDataFrame([(*r, 0, "z") for r in TALK], SCHEMA)
    got = {(r.conv_id, r.speaker): (r.text, r.mask) for r in chat.rotate(df).collect()}
    want = {(c, s): rendered(rows, s) for c, rows in _talks().items() for s in {r for _, r, _ in rows}}
    assert got == want
    assert chat.rotate(df.where("false")).count() == 0
    plan = chat.rotate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_conversations_come_in_parts(spark):
    rows = [(7, i // 2, f"s{i % 3}", f"said {i}") for i in range(57)] + [(8, 0, "s0", "short")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], SCHEMA)
    for most in (100, 0):
        out = chat.rotate(df, whole_turns=10, broadcast_rows=most).collect()
        assert max(r.n_turns for r in out) <= 10
        for speaker in ("s0", "s1", "s2"):
            parts = sorted((r for r in out if (r.conv_id, r.speaker) == (7, speaker)), key=lambda r: r.part)
            want, _ = rendered([(t, r, x) for c, t, r, x in rows if c == 7], speaker)
            assert "".join(p.text for p in parts) == want
            for p in parts:
                spans = [tuple(map(int, x.split("-"))) for x in p.mask.split(",") if x]
                assert sum(b - a for a, b in spans) == p.n_masked
                assert all(p.text[b - 7:b] == "<|end|>" for _, b in spans)


def test_long_conversations_are_one_row_in_the_query(spark, tmp_path):
    rows = [(c, i // 2, f"s{i % 3}", f"said é {i}") for c in (7, None) for i in range(2 * chat.WHOLE_TURNS + 99)]
    rows += [(7, 0, "once", "hi"), (8, 0, "s0", "short")]
    spark.createDataFrame([(*r, 0, "z") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, chat.op3_chat_rotation(spark, str(tmp_path)).collect()), key=str)
    want = []
    for conv in (7, 8, None):
        own = [(t, r, x) for c, t, r, x in rows if c == conv]
        for speaker in {r for _, r, _ in own}:
            said = [x for _, r, x in own if r == speaker]
            text, mask = rendered(own, speaker)
            want.append((conv, speaker, 0, len(own), len(said), sum(len(x) + 7 for x in said), mask, text))
    assert got == sorted(want, key=str)
