"""Fill-in-middle transformation with chunk memoisation.

Every text is cut at two unit positions into prefix, middle and suffix, which are
written behind sentinels in one of two orders:

* ``psm``: prefix, suffix, middle,
* ``spm``: suffix, prefix, middle,
* ``plain``: the text as it is.

The positions and the form come from the hash of the document's id alone, so a
rerun or a retried task gives the same output.  Units are counted from the
memoised summaries of content-defined chunks (``chunks``): a cut is found by
adding up chunk counts and looking into one chunk.

``fill_in_middle`` adds a struct column ``into``; ``restored`` rebuilds the exact
text from the output and its form, with SQL functions.

Defined cases: a NULL text reads as empty; an empty text, and one that contains a
sentinel, is plain with NULL lengths; a NULL id is hashed as no digits; repeated
rows get equal outputs; an empty table gives no rows; other columns are kept
untouched (a column that is named like ``into``, in any letter case, is refused).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import CutText, SummaryCache
from .common import fresh, importable, read_table, whole_text

SENTINELS = ("<P>", "<S>", "<M>")      # prefix, suffix, middle
PLAIN_FROM = 90                         # of 100 documents, those from this number on stay plain
SPM_BELOW = 20                          # of 100 transformed ones, those below this number are spm
SEED = 1

FIELDS = "n long, form string, prefix_units long, middle_units long, output binary"


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers: the first hexadecimal groups of a SHA-256."""
    key = f"{seed}:" if doc_id is None else f"{seed}:{doc_id}"
    digest = hashlib.sha256(key.encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def transform(data: bytes, doc_id: int | None, cache: SummaryCache, marks: tuple[bytes, bytes, bytes],
              plain_from: int, spm_below: int, seed: int) -> tuple:
    """One text's row of ``FIELDS``."""
    text = CutText(data, cache)
    first, second, form, order = draws(doc_id, seed)
    if not data or any(m in data for m in marks) or form % 100 >= plain_from:
        return text.n, "plain", None, None, data
    one, two = sorted((first % (text.n + 1), second % (text.n + 1)))
    a, b = text.offset(one), text.offset(two)
    p, s, m = marks
    if order % 100 < spm_below:
        return text.n, "spm", one, two - one, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return text.n, "psm", one, two - one, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "fim",
                   unit: str = "chars", sentinels: tuple[str, str, str] = SENTINELS,
                   plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, seed: int = SEED) -> DataFrame:
    """``docs`` with a struct column ``into``: n, form, prefix_units, middle_units, output."""
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {into!r} exists already")
    if any(not s for s in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("three different sentinels are needed")
    importable(docs.sparkSession)
    marks = tuple(s.encode() for s in sentinels)
    schema = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()),
                        ("middle_units", pa.int64()), ("output", pa.binary())])

    @F.arrow_udf(FIELDS)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache = SummaryCache(unit)
        for ids, texts in batches:
            rows = [transform(t or b"", i, cache, marks, plain_from, spm_below, seed)
                    for i, t in zip(ids.to_pylist(), texts.to_pylist())]
            yield pa.StructArray.from_arrays(
                [pa.array([r[k] for r in rows], type=field.type) for k, field in enumerate(schema)],
                fields=list(schema))

    name = fresh(docs, "cut")
    made = docs.withColumn(name, cut(F.col(id_col).cast("long"), whole_text(text_col).cast("binary")))
    return made.select(*docs.columns, F.col(name).withField(
        "output", F.col(f"{name}.output").cast("string")).alias(into))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made from; no text that holds a sentinel is ever cut,
    so the first place of each sentinel is the one that was written."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        left = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(left) + F.lit(len(second) + 1), F.length(body))
        right = F.substring_index(rest, m, 1)
        return left, right, F.substring(rest, F.length(right) + F.lit(len(m) + 1), F.length(rest))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and checksums of every document's transformed text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fim = fill_in_middle(docs).select("doc_id", "fim.*")
    return fim.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


OP13_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4
  FROM texts),
cuts AS (
  SELECT doc_id, text, n,
         CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a,
         CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix
  FROM cuts)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
