"""License scan by ordered signature rules, in DataFrame functions only.

The text is lower-cased (A-Z), cut into words and joined by single spaces.  A
text that has none of the rules' keywords is done.  Otherwise every rule whose
keyword occurs is matched; detections are word intervals.  They are resolved by
strength of evidence, at equal strength by start, longest first: a detection stays if
it overlaps none that stays, so one is never lost to a detection that goes itself.
Labels of the base phrases always stay.

Everything happens within a row: one scan, no shuffle, so hot sources or copies
cost no more than other rows.

Defined cases: a NULL or empty text has no words, no labels and score 0; repeated
rows give equal rows; equal intervals of equal strength are decided by the
rules' order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, whole_text
from .license_rules import BASE, rules

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Words in lower case, a space before, between and after them."""
    lowered = F.translate(text, _UPPER, _UPPER.lower())
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, NOT_WORD, " ")), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _whole_words(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _rule_array(table) -> Column:
    return F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"),
                 F.lit(confidence).alias("confidence"), F.lit(f" {keyword}").alias("keyword"),
                 F.lit(_whole_words(pattern)).alias("pattern"), F.lit(i).alias("rule"))
        for i, (label, priority, confidence, keyword, pattern) in enumerate(table)])


_OPEN, _CLOSE = "\x01", "\x02"      # no characters of words
CHAIN_STEP, PART = 32, 4096
DETECTION = ("array<struct<start:int,neg_stop:int,priority:int,rule:int,label:string,"
             "confidence:double>>")


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(items: Column, size: int) -> Column:
    """A filled array as arrays of ``size`` items, in order."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")),
                       lambda i: F.slice(items, i * size + 1, F.lit(size)))


def _detections(norm: Column, rule: Column) -> Column:
    """Word intervals where one rule matches, in order of place: matches are marked in the
    text, so that the numbers of its marked words are their places."""
    none = F.array().cast(DETECTION)

    def numbered(words, is_edge, shift):
        return F.filter(F.transform(words, lambda w, i: F.when(is_edge(w), i - shift)), F.isnotnull)

    def placed(words):
        starts = numbered(words, lambda w: F.startswith(w, F.lit(_OPEN)), 1)
        stops = numbered(words, lambda w: F.endswith(w, F.lit(_CLOSE)), 0)
        return F.zip_with(starts, stops, lambda start, stop: F.struct(
            start.alias("start"), (-stop).alias("neg_stop"), rule["priority"].alias("priority"),
            rule["rule"].alias("rule"), rule["label"].alias("label"),
            rule["confidence"].alias("confidence")))

    marked = F.regexp_replace(norm, rule["pattern"], F.lit(f"{_OPEN}$0{_CLOSE}"))
    return _bound(marked, lambda m: F.when(
        F.contains(m, F.lit(_OPEN)), _bound(F.split(m, " "), placed)).otherwise(none))


def _strongest(found: Column) -> Column:
    """The detections that stay, the strongest first, then by place: each stays if it
    overlaps none that stays."""
    def step(kept, one):
        clash = F.exists(kept, lambda k: (one["start"] < -k["neg_stop"]) & (k["start"] < -one["neg_stop"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(one)))

    ranked = F.transform(F.array_sort(F.transform(found, lambda d: F.struct(
        d["priority"].alias("priority"), d.alias("d")))), lambda r: r["d"])
    return F.aggregate(ranked, F.array().cast(DETECTION), step)


def _resolved(found: Column) -> Column:
    """Detections without overlaps, in order of place.

    In order of start they fall into chains of overlaps, which do not touch each other.
    ``CHAIN_STEP`` at a time are taken up; the chains that ended are resolved, the last
    waits for more.  So the work is in proportion to the detections, but for the square
    of a single unbroken chain.
    """
    none = F.array().cast(DETECTION)

    def last_chain(ordered):
        """Number of detections before the last chain."""
        at = F.aggregate(
            ordered, F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"), F.lit(0).alias("before")),
            lambda acc, d: F.struct(
                (acc["n"] + 1).alias("n"), F.greatest(acc["stop"], -d["neg_stop"]).alias("stop"),
                F.when(d["start"] >= acc["stop"], acc["n"]).otherwise(acc["before"]).alias("before")))
        return at["before"]

    def step(acc, some):
        # what is bound is copied: the chains that are done stay outside
        joined = F.concat(acc["open"], some)
        return F.struct(
            _bound(joined, lambda o: F.slice(o, last_chain(o) + 1, F.size(o))).alias("open"),
            F.concat(acc["done"], F.array(_bound(
                joined, lambda o: _strongest(F.slice(o, F.lit(1), last_chain(o)))))).alias("done"))

    def chains(ordered):
        # a slice costs as much as the array it is cut from, so steps are cut from larger parts
        some = F.flatten(F.transform(_cut(ordered, PART), lambda part: _cut(part, CHAIN_STEP)))
        return F.aggregate(
            some, F.struct(none.alias("open"), F.array().cast(f"array<{DETECTION}>").alias("done")), step,
            lambda acc: F.array_sort(F.flatten(F.concat(acc["done"], F.array(_strongest(acc["open"]))))))

    return _bound(F.array_sort(found), lambda ordered: F.when(
        F.size(ordered) == 0, none).otherwise(chains(ordered)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table=None) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    the kept ``detections`` (start, stop, label, confidence; words from 0)."""
    table = table or rules()
    norm = F.col("norm")
    keywords = sorted({k for _, _, _, k, _ in table}, key=len)
    needed = [k for i, k in enumerate(keywords) if not any(s in f" {k}" for s in
                                                          (f" {x}" for x in keywords[:i]))]
    gate = reduce(Column.__or__, [F.contains(norm, F.lit(f" {k}")) for k in needed])
    tried = F.filter(_rule_array(table), lambda r: F.contains(norm, r["keyword"]))
    empty = F.array().cast(DETECTION)
    base = [(label, _rule_array([(label, 0, 0.0, phrase, phrase)])[0], phrase)
            for phrase, label in BASE.items()]
    base_found = F.concat(*[
        F.when(F.contains(norm, F.lit(f" {phrase} ")), _detections(norm, rule)).otherwise(empty)
        for _, rule, phrase in base])
    rows = docs.select(F.col(id_col), normalised(whole_text(text_col)).alias("norm"))
    rows = rows.select(
        id_col, F.when(norm == "  ", 0).otherwise(_spaces(norm) - 1).cast("long").alias("n_words"),
        F.when(gate, F.struct(
            base_found.alias("base"),
            _resolved(F.flatten(F.transform(tried, lambda r: _detections(norm, r)))).alias("kept"))
        ).otherwise(F.struct(empty.alias("base"), empty.alias("kept"))).alias("found"))
    starts = F.transform("found.base", lambda d: d["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform("found.base", lambda d: d["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("found.kept", lambda d: d["label"])))
    return rows.select(
        id_col, "n_words", F.size("found.base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found.kept", lambda d: d["confidence"])),
                   F.lit(0.0)).alias("score"),
        F.transform("found.kept", lambda d: F.struct(
            d["start"].alias("start"), (-d["neg_stop"]).alias("stop"), d["label"].alias("label"),
            d["confidence"].alias("confidence"))).alias("detections"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    return scan(read_table(spark, sf_dir, "documents")).drop("detections")
