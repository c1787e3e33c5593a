"""Quality rules: word and line repetition, and tokeniser fertility.

Every whitespace word goes through public vocabularies, once per worker.  A
text's fertility figures are

* ``chars_per_token``: code points in words per token of the piece vocabulary,
* ``bpe_chars_per_token``: the same for the byte-level vocabulary,
* ``fallback_share``: share of piece tokens that are single-byte fallbacks,
* ``token_entropy``: entropy of the piece-token distribution as a share of the
  highest value possible for that many tokens, at most ``ENTROPY_BITS`` bits.

``BANDS`` holds the accepted range of each figure by language; a text whose
language is absent or unknown is judged by its script.  Ranges are constants,
set wide around ordinary prose, so a text's verdict depends on nothing but
itself.

Defined cases: a NULL or empty text has no words and fails the base rule; a NULL
language is judged by script; ties and repeated rows are judged alike; an empty
table gives no rows; other columns are kept untouched, whatever their names.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, importable, read_table, worker_table
from .tokens import default_vocabulary

_WORDS = re.compile("[^\x20\x09-\x0D]+")
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"

# figure -> (least, most), by language, else by script.
_LATIN = {"chars_per_token": (1.5, 6.5), "bpe_chars_per_token": (1.5, 7.0),
          "fallback_share": (0.0, 0.10), "token_entropy": (0.40, 1.5)}
BANDS = {
    "en": _LATIN | {"chars_per_token": (1.9, 6.5), "bpe_chars_per_token": (2.0, 7.0)},
    "de": _LATIN | {"chars_per_token": (1.9, 6.5), "bpe_chars_per_token": (1.8, 7.0)},
    "fr": _LATIN | {"chars_per_token": (1.6, 6.5), "bpe_chars_per_token": (1.6, 7.0)},
    "es": _LATIN | {"chars_per_token": (1.7, 6.5), "bpe_chars_per_token": (1.6, 7.0)},
    "script:latin": _LATIN,
    "script:cyrillic": _LATIN | {"chars_per_token": (1.0, 6.5), "bpe_chars_per_token": (0.4, 7.0)},
    "script:other": {"chars_per_token": (0.2, 8.0), "bpe_chars_per_token": (0.2, 8.0),
                     "fallback_share": (0.0, 0.95), "token_entropy": (0.30, 1.5)},
}
ENTROPY_BITS = 10.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

METRICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "chars_per_token double, bpe_chars_per_token double, fallback_share double, "
           "token_entropy double, base_failed boolean, kept boolean")
_COLS = [x.split()[0] for x in METRICS.split(", ")]


def _rank_encoding(path: str):
    """A byte-level vocabulary from its rank file (``base64-token rank`` lines)."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


class _WordTable:
    """Token figures of single words under both vocabularies, numbered in order of arrival.

    ``prepare`` sends the words that are new through the libraries in one call; the
    table starts anew once its words, at ``ENTRY`` bytes besides their characters,
    reach ``capacity`` bytes.
    """

    ENTRY = 220

    def __init__(self, piece_path: str, byte_path: str, capacity: int = 64 << 20):
        import sentencepiece
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.bytes = _rank_encoding(byte_path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.capacity = capacity
        self._empty()

    def _empty(self):
        self.number: dict[str, int] = {}
        self.size = 0
        self.ids = np.empty(0, dtype=np.uint16)
        self.stops = np.zeros(1, dtype=np.int64)       # ids of word i: ids[stops[i]:stops[i + 1]]
        self.byte_tokens = np.empty(0, dtype=np.int32)

    def prepare(self, words: set[str]):
        new = [w for w in words if w not in self.number]
        more = sum(map(len, new)) + self.ENTRY * len(new)
        if self.number and self.size + more > self.capacity:
            self._empty()
            new = list(words)
            more = sum(map(len, new)) + self.ENTRY * len(new)
        if not new:
            return
        self.size += more
        found = self.pieces.encode(new, num_threads=1)
        self.byte_tokens = np.concatenate((self.byte_tokens, np.fromiter(
            (len(self.bytes.encode_ordinary(" " + w)) for w in new), np.int32, len(new))))
        self.stops = np.concatenate((self.stops, self.stops[-1] + np.cumsum([len(x) for x in found])))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), np.uint16)))
        first = len(self.number)
        self.number.update(zip(new, range(first, first + len(new))))

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def fertility(self, numbers: np.ndarray) -> tuple[int, int, float, float]:
        """Piece tokens, byte-level tokens, fallback share, relative entropy."""
        starts = self.stops[numbers]
        lengths = self.stops[numbers + 1] - starts
        total = int(lengths.sum())
        shift = starts - (np.cumsum(lengths) - lengths)
        tokens = self.ids[np.arange(total) + np.repeat(shift, lengths)]
        counts = np.bincount(tokens, minlength=len(self.is_byte))
        p = counts[counts > 0] / total
        most = min(math.log2(total), ENTROPY_BITS) if total > 1 else 1.0
        return (total, int(self.byte_tokens[numbers].sum()),
                float(counts[self.is_byte].sum() / total), float(-(p * np.log2(p)).sum() / most))


def _word_table(piece_path: str, byte_path: str) -> _WordTable:
    return worker_table(("words", piece_path, byte_path), lambda: _WordTable(piece_path, byte_path),
                        alone=True)


def repeated_words(numbers: np.ndarray) -> int:
    """Words covered by 3-word windows that occur twice or more, first included.

    ``numbers`` stand for words; where all are below 2**21, three fit in 63 bits,
    else the pairs that begin a window are numbered first.
    """
    n = len(numbers)
    if n < 4:
        return 0
    if int(numbers.max()) >> 21:
        pairs = np.unique((numbers[:-2] << 32) | numbers[1:-1], return_inverse=True)[1]
        code = (pairs << 32) | numbers[2:]
    else:
        code = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    ordered = np.sort(code)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(code)
    same = code[order[1:]] == code[order[:-1]]
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return int(covered.sum())


def _groups(texts, most_chars: int = 2_000_000):
    """Positions of consecutive texts, cut so that a group has few characters."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(i)
        size += len(text)
        if size >= most_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _script(text: str) -> str:
    """Majority script of the letters: latin, cyrillic or other."""
    letters = np.array([ord(c) for c in text if c.isalpha()], dtype=np.int64)
    latin = int((letters < 0x250).sum())
    cyrillic = int(((letters >= 0x400) & (letters < 0x530)).sum())
    if latin * 2 >= len(letters):
        return "script:latin"
    return "script:cyrillic" if cyrillic * 2 >= len(letters) else "script:other"


def measure(text: str, words: list[str], lang: str | None, table: _WordTable, bands: dict) -> tuple:
    """One text's figures and verdict, in the order of ``METRICS``."""
    n, word_chars = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    numbers = table.numbers(words)
    repeat = repeated_words(numbers)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    kept, cpt, bpe_cpt, share, entropy = not failed, None, None, None, None
    if n:
        tokens, byte_tokens, share, entropy = table.fertility(numbers)
        cpt, bpe_cpt = word_chars / tokens, word_chars / byte_tokens
    if kept:
        band = bands.get(lang) or bands[_script(text)]
        for name, value in (("chars_per_token", cpt), ("bpe_chars_per_token", bpe_cpt),
                            ("fallback_share", share), ("token_entropy", entropy)):
            least, most = band[name]
            kept &= least <= value <= most
    return (n, word_chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeat,
            cpt, bpe_cpt, share, entropy, failed, kept)


def measure_all(texts, langs, table: _WordTable, bands: dict) -> pd.DataFrame:
    texts, langs, rows = [t or "" for t in texts], list(langs), []
    for group in _groups(texts):
        words = [_WORDS.findall(texts[i]) for i in group]
        table.prepare(set(chain.from_iterable(words)))
        rows += [measure(texts[i], w, langs[i], table, bands) for i, w in zip(group, words)]
    return pd.DataFrame(rows, columns=_COLS)


def score(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", into: str = "quality",
          piece_vocabulary: str | None = None, byte_vocabulary: str | None = None,
          bands: dict | None = None) -> DataFrame:
    """``docs`` with one more struct column ``into`` that holds the figures."""
    importable(docs.sparkSession)
    piece_path = piece_vocabulary or default_vocabulary("piece_bpe_32k.model")
    byte_path = byte_vocabulary or default_vocabulary("byte_bpe_50k.tiktoken")
    limits = bands or BANDS

    @F.pandas_udf(METRICS)
    def figures(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = _word_table(piece_path, byte_path)
        for texts, langs in batches:
            yield measure_all(texts, langs, table, limits)

    # Not deterministic for the optimizer only: it must not run the function once
    # for a filter and once more for the output.
    return docs.withColumn(into, figures.asNondeterministic()(F.col(text_col), F.col(lang_col).cast("string")))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with the same columns."""
    name = fresh(docs, "quality")
    return score(docs, text_col, lang_col, name).where(F.col(f"{name}.kept")).drop(name)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return score(docs).select("doc_id", "quality.*")
