"""Token ids through the public tokenizer libraries, with a pre-token cache.

A byte-level BPE never merges across its pre-tokens, so the ids of a text are
the ids of its pre-tokens in order.  Texts made of the characters below are cut
with an equivalent ``re`` pattern and every distinct pre-token goes through the
library once per worker; any other text is encoded whole by the library.  Both
ways give the library's ids (``tests/llm/test_tokens.py`` compares them).
"""

from __future__ import annotations

import json
import os
import re
import struct
from itertools import chain

import numpy as np

from .common import worker_table
from .shingles import mix

# Letters whose class is the same for ``re`` as for the tokenizer's \p{L}.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER = re.compile(f"[^\\t\\n\\r\\x20-\\x7e{_LETTERS}]")


def _pieces(letters: str) -> re.Pattern:
    """The tokenizer's alternatives; words and numbers, which no other one before them matches, first."""
    return re.compile(f" ?[{letters}]++| ?[0-9]++|'s|'t|'re|'ve|'m|'ll|'d| ?[^\\s0-9{letters}]++|\\s+(?!\\S)|\\s+")


_PIECES, _ASCII_PIECES = _pieces(_LETTERS), _pieces("A-Za-z")


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, int]:
    """The fixed byte-to-character map of byte-level vocabularies (GPT-2's): printable
    Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in plain)}


# Classes of the bytes of such a text; bytes of 128 and more belong to letters.
_END, _SPACE, _BLANK, _LETTER, _DIGIT, _MARK = range(6)


def _classes() -> np.ndarray:
    out = np.full(256, _MARK, dtype=np.uint8)
    out[0], out[0x20], out[[0x09, 0x0A, 0x0D]] = _END, _SPACE, _BLANK
    out[0x30:0x3A], out[0x80:] = _DIGIT, _LETTER
    out[0x41:0x5B] = out[0x61:0x7B] = _LETTER
    return out


_CLASS = _classes()
_SUFFIX = np.zeros((256, 256), dtype=np.uint8)      # letters after an apostrophe that make a piece with it
_SUFFIX[[ord(c) for c in "stmd"]] = 1
for _pair in ("re", "ve", "ll"):
    _SUFFIX[ord(_pair[0]), ord(_pair[1])] = 2
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def piece_starts(buf: np.ndarray) -> np.ndarray:
    """Where pieces begin, as ``_PIECES`` cuts them, in texts that each end with a zero byte.
    These zero bytes are pieces of their own."""
    kind = _CLASS[buf]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], before[1:], after[-1], after[:-1] = _END, kind[:-1], _END, kind[1:]
    blank = (kind == _SPACE) | (kind == _BLANK)
    # the last blank of a run goes with what follows, if it is a space, or stands alone
    start = np.where(blank, (before == _END) | (before > _BLANK) | (after > _BLANK),
                     (kind != before) & (before != _SPACE) | (kind == _END))
    quote = np.flatnonzero((buf == 0x27) & start & (after == _LETTER))
    if len(quote):
        taken = _SUFFIX[buf[quote + 1], buf[quote + 2]]
        quote, taken = quote[taken > 0], taken[taken > 0]
        start[quote + 1] = False
        rest = quote + 1 + taken
        start[rest[kind[rest] == _LETTER]] = True
    return np.flatnonzero(start)


def _words(buf: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The next 8 bytes from each place on, as a number; bytes behind ``sizes`` are zero.
    ``buf`` goes on for 8 bytes."""
    rows = np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1))[at]
    return rows.view("<u8").ravel().astype(np.uint64) & _KEPT[np.minimum(sizes, 8)]


WORDS_OF_PIECE = 4              # longer pieces are told apart one by one


def distinct_pieces(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(one place of each distinct piece, number of every piece), by content; ``None`` if two
    pieces had one hash.  Pieces hold no zero byte and at most 8 * ``WORDS_OF_PIECE`` bytes."""
    key, parts = np.zeros(len(starts), dtype=np.uint64), []
    for k in range(WORDS_OF_PIECE):
        who = np.flatnonzero(sizes > 8 * k)
        if not len(who):
            break
        word = _words(buf, starts[who] + 8 * k, sizes[who] - 8 * k)
        key[who] = mix(key[who] ^ word)
        parts.append((who, word))
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    if (sizes[first][number] != sizes).any():
        return None
    for k, (who, word) in enumerate(parts):
        own, long = np.zeros(len(first), dtype=np.uint64), np.flatnonzero(sizes[first] > 8 * k)
        own[long] = _words(buf, starts[first[long]] + 8 * k, sizes[first[long]] - 8 * k)
        if (own[number[who]] != word).any():
            return None
    return first, number


CACHE_BYTES = 80 << 20
GROUP_CHARS = 1 << 20            # of texts whose pieces are told apart together


class _Cache(dict):
    """Bytes of a piece's ids, in two generations: once the young one holds ``capacity`` pieces or
    half of ``CACHE_BYTES`` it becomes the old one, whose pieces come back when they are met
    again; the old one before it goes.  Pieces of more than ``longest`` characters are not kept.
    ``ENTRY`` is what an entry takes besides its content (two objects and its place)."""

    ENTRY = 150

    def __init__(self, encode_one, capacity, longest):
        super().__init__()
        self.encode_one, self.capacity, self.longest = encode_one, capacity, longest
        self.size, self.old = 0, {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.encode_one(piece)
            if len(piece) > self.longest:
                return value
        self.size += self.ENTRY + len(piece) + len(value)
        if len(self) >= self.capacity or self.size > CACHE_BYTES // 2:
            self.old = dict(self)
            self.clear()
            self.size = self.ENTRY + len(piece) + len(value)
        self[piece] = value
        return value


def _parts(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Parts of a piece after all merges to tokens of ranks under ``below``, lowest rank first."""
    parts = [piece[k:k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        found = [ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
        least = min(found)
        if least >= below:
            break
        k = found.index(least)
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return parts


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids of a byte-level vocabulary by token, if merging by lowest id gives the ids that its
    list of merges gives; ``None`` if that is not sure.

    It does if ids rise along the list and every token, merged from its bytes by lower ids
    alone, ends in the two parts that the list names: within a text, merges inside a
    token's bytes come in the same order, unless one reaches over its border, and then the
    token does not arise at all."""
    model, chars = spec["model"], _byte_chars()
    vocab = model.get("vocab")
    if model.get("type") != "BPE" or any(model.get(x) for x in (
            "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    byte = {chr(chars.get(b, b)): bytes([b]) for b in range(256)}
    if not all(c in vocab for c in byte):
        return None
    ranks, last = {b: vocab[c] for c, b in byte.items()}, -1
    for merge in model["merges"]:
        a, b = (b"".join(byte[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
        number = vocab["".join(merge.split(" ") if isinstance(merge, str) else merge)]
        if number <= last or a + b in ranks or _parts(a + b, ranks, number) != [a, b]:
            return None
        ranks[a + b] = last = number
    return ranks


class _PieceTable:
    """Ids of pieces (UTF-8), numbered in order of arrival.  New pieces of a call are encoded
    together; the table starts anew once it would hold more than ``CACHE_BYTES``, at ``ENTRY``
    bytes a piece besides its characters."""

    ENTRY = 190

    def __init__(self, encode_one, dtype: np.dtype):
        self.encode_one, self.dtype = encode_one, dtype
        self._empty()

    def _empty(self):
        self.number: dict[bytes, int] = {}
        self.size = 0
        self.ids, self.stops = np.empty(0, dtype=self.dtype), np.zeros(1, dtype=np.int64)

    def _size(self, pieces: list[bytes]) -> int:
        return sum(map(len, pieces)) + self.ENTRY * len(pieces)

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of the pieces; ids of number i: ids[stops[i]:stops[i + 1]]."""
        new = [x for x, n in zip(pieces, map(self.number.get, pieces)) if n is None]
        if self.number and self.size + self._size(new) > CACHE_BYTES:
            self._empty()
            new = pieces
        if new:
            self.size += self._size(new)
            found, first = list(map(self.encode_one, new)), len(self.stops) - 1
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), self.dtype)))
            self.stops = np.concatenate((self.stops, self.stops[-1] + np.cumsum([len(x) for x in found])))
            self.number.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))


class PieceEncoder:
    """Encode texts to little-endian id bytes with a ``tokenizers`` vocabulary."""

    def __init__(self, path: str, capacity: int = 1_000_000, longest_cached: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space") and not spec.get("normalizer")
                         and not spec.get("post_processor"))
        self.path, self.model = path, self.tokenizer.model
        self.byte_chars = _byte_chars()
        self.space = chr(self.byte_chars[0x20])
        self.cache = _Cache(self._one_piece, capacity, longest_cached)
        self.table = None                           # of ``encode_all``, made when it is first asked for

    def _library(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        """Little-endian ids of ``self.dtype``."""
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def _one_piece(self, piece: str) -> bytes:
        return self.packed(self._piece_ids(piece))

    def _piece_ids(self, piece: str) -> list[int]:
        """The library's merges on one pre-token, given in the vocabulary's byte characters."""
        if piece.isascii() and piece.isprintable():     # of these, only the space has another character
            named = piece.replace(" ", self.space)
        else:
            named = piece.encode().decode("latin-1").translate(self.byte_chars)
        return [t.id for t in self.model.tokenize(named)]

    def _piece_table(self) -> _PieceTable:
        """Its new pieces go through the faster public library where it is sure to give the same ids."""
        with open(self.path, encoding="utf-8") as f:
            ranks = merge_ranks(json.load(f))
        if ranks is None:
            return _PieceTable(lambda piece: self._piece_ids(piece.decode()), self.dtype)
        import tiktoken
        core = tiktoken.Encoding(self.path, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return _PieceTable(core.encode_single_piece, self.dtype)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """``ids`` of every text.  The pieces of all plain texts are cut and told apart together;
        each distinct one is looked up once."""
        out = [np.empty(0, dtype=self.dtype)] * len(texts)
        plain, group, held = [], [], 0
        for k, text in enumerate(texts):
            if text and (not self.by_piece or _OTHER.search(text)):
                out[k] = np.frombuffer(self._library(text), dtype=self.dtype)
            elif text:
                plain.append(k)
        for n, k in enumerate(plain):
            group.append(k)
            held += len(texts[k])
            if held >= GROUP_CHARS or n == len(plain) - 1:
                for i, ids in zip(group, self._plain([texts[i] for i in group])):
                    out[i] = ids
                group, held = [], 0
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        data = [t.encode() for t in texts]
        whole = b"\0".join([*data, b"\0" * 8])
        length = len(whole) - 7                     # the last text's zero byte, and 7 more
        buf = np.frombuffer(whole, dtype=np.uint8)
        starts = piece_starts(buf[:length])
        sizes = np.diff(starts, append=length)
        piece = buf[starts] != 0
        starts, sizes = starts[piece], sizes[piece]
        if self.table is None:
            self.table = self._piece_table()
        short = np.flatnonzero(sizes <= 8 * WORDS_OF_PIECE)
        told = distinct_pieces(buf, starts[short], sizes[short])
        if told is None:
            return [self.ids(t) for t in texts]
        first, number = told
        number_of = np.empty(len(starts), dtype=np.int64)
        number_of[short] = number
        long = np.flatnonzero(sizes > 8 * WORDS_OF_PIECE)
        number_of[long] = len(first) + np.arange(len(long))
        at = np.concatenate((short[first], long))
        lo = starts[at]
        number = self.table.numbers([whole[a:b] for a, b in zip(lo.tolist(), (lo + sizes[at]).tolist())])[number_of]
        begin = self.table.stops[number]
        many = self.table.stops[number + 1] - begin
        stop = np.cumsum(many)
        ids = self.table.ids[np.arange(int(stop[-1])) + np.repeat(begin - (stop - many), many)]
        ends = np.cumsum([len(x) + 1 for x in data])
        cuts = np.concatenate(([0], stop))[np.searchsorted(starts, ends)]
        return np.split(ids, cuts[:-1])

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as bytes of ``self.dtype``; NULL reads as empty."""
        if not text:
            return b""
        if not self.by_piece or _OTHER.search(text):
            return self._library(text)
        pieces = _ASCII_PIECES if text.isascii() else _PIECES
        return b"".join(map(self.cache.__getitem__, pieces.findall(text)))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype=self.dtype)


def encoder(path: str) -> PieceEncoder:
    """One encoder per vocabulary file and Python worker."""
    return worker_table(("encoder", path), lambda: PieceEncoder(path), alone=True)
