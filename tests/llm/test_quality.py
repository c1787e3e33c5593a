import re
from collections import Counter

import numpy as np

from sitetally.llm import quality

from . import cases


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)


def test_base_figures(spark):
    more = [(20, "a|b # c $$$ <x>\nsame line\nsame line\n same line\n\n"), (21, "\x0b\x0c w x y z"),
            (22, "one two three one two three one two")]
    rows = cases.texts() + more
    got = quality.score(cases.documents(spark, rows), into="q").select("text", "q.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert not (r.base_failed and r.kept)
        assert (r.chars_per_token is None) == (r.n_words == 0)


def test_fertility_matches_the_library(spark):
    import sentencepiece
    from sitetally.llm.tokens import default_vocabulary
    model = sentencepiece.SentencePieceProcessor(model_file=default_vocabulary("piece_bpe_32k.model"))
    text = cases.prose(80, 9) + " 日本 語"
    ids = [i for w in text.split() for i in model.encode(w)]
    r = quality.score(spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string")) \
        .select("quality.*").first()
    assert abs(r.chars_per_token - len(text.replace(" ", "")) / len(ids)) < 1e-12
    assert abs(r.fallback_share - sum(map(model.is_byte, ids)) / len(ids)) < 1e-12


def test_bands_reject_and_keep(spark):
    clean = cases.prose(200, 5)
    noise = " ".join(f"ཀ{i}ཁሀ" for i in range(80))      # byte fallbacks throughout
    docs = spark.createDataFrame([(1, clean, "en", 9), (2, noise, "en", 9), (3, clean, None, 9), (4, None, "en", 9)],
                                 "doc_id long, text string, lang string, quality int")
    bands = {"en": {"chars_per_token": (0.1, 9), "bpe_chars_per_token": (0.1, 9), "fallback_share": (0, 0.1),
                    "token_entropy": (0.1, 2)}}
    bands |= {"script:latin": bands["en"], "script:other": bands["en"], "script:cyrillic": bands["en"]}
    kept = quality.score(docs, into="q", bands=bands).where("q.kept").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
    out = quality.keep_good(docs)
    assert out.columns == docs.columns


def test_empty_table(spark):
    assert quality.score(cases.documents(spark, []), into="q").count() == 0


def test_repeated_words_of_very_many_distinct_words():
    high = 1 << 21
    apart = np.array([5, 0, high, 9, 5, 1, 0, 8], dtype=np.int64)       # equal when packed in 21 bits each
    assert quality.repeated_words(apart) == 0
    assert quality.repeated_words(np.concatenate((apart, [7], apart[:3]))) == 6
    assert quality.repeated_words(np.array([high, high, high, high], dtype=np.int64)) == 4
