"""Fact -> (facility, section) mapping.

Mapping tables are small configuration (tens to thousands of rows) while
fact tables are the large side.  Two exact strategies produce the same
section-level partial states:

* **broadcast** (mapping within ``broadcast_rows``): map-side hash join, then
  one aggregation by (by, facility, section).  One shuffle, of at most
  ``#groups`` rows per input partition thanks to partial aggregation.
* **pre-aggregate** (mapping too large to broadcast): aggregate facts by
  (by, key) first, so a hot key collapses map-side to one row per
  partition, then shuffle-join the key-level states (one row per distinct
  key) with the mapping, then aggregate by section.

Neither strategy drops rows: unmapped facts are kept under a NULL facility
(``unmapped='keep'``) or excluded by an inner join (``unmapped='drop'``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitetally.functions.measures import BIN, Measure

LABELS = ("facility", "section")

# Mapping tables larger than this are joined without a broadcast.
DEFAULT_BROADCAST_ROWS = 200_000
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024

def _value_bytes(df: DataFrame) -> Column:
    width = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
             for c in df.columns] or [F.lit(0)]
    return sum(width[1:], width[0]) + F.lit(8 * len(df.columns))


def _text_bytes(values) -> int:
    return sum(len(str(v).encode()) for v in values if v is not None) + 8 * len(values)


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                   max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """Size check for configuration tables (mappings, rules): row count and data size
    (UTF-8 bytes of every value as text) must be within bounds.  A local table is
    measured as it is, any other in one partially aggregated pass.  Nothing is
    remembered between calls, so a table overwritten in place is measured anew."""
    if df.isLocal():
        rows = df.collect()
        return len(rows) <= max_rows and sum(map(_text_bytes, rows)) <= max_bytes
    m = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_value_bytes(df)).alias("b")).first()
    return m["n"] <= max_rows and (m["b"] or 0) <= max_bytes


def sized_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df`` as is
    (Spark then plans a shuffle join, and AQE may still broadcast it at run
    time if it turns out small)."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def usable_keys(mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mapping rows that can match a fact: no key is NULL or blank.  Blank cells
    never match, as a NULL key never does; ``validate_mapping`` reports them."""
    cond = None
    for k in keys:
        term = F.nullif(F.trim(F.col(k).cast("string")), F.lit("")).isNotNull()
        cond = term if cond is None else cond & term
    return mapping.filter(cond)


def check_mapping(mapping: DataFrame, keys: Sequence[str],
                  max_rows: int = DEFAULT_BROADCAST_ROWS,
                  max_bytes: int = DEFAULT_BROADCAST_BYTES, unique: bool = True,
                  local: bool = False) -> bool:
    """Refuse duplicate keys and tell whether the mapping may be broadcast.

    A key with several rows would repeat every fact of that key and silently
    inflate its totals.  Row count, bytes and the most frequent key come from one
    aggregation per call, or from the rows of a ``local`` table, which needs no job.
    """
    keys = list(keys)
    if local:
        rows = mapping.collect()
        counts = Counter(tuple(r[k] for k in keys) for r in rows)
        size = (len(rows), sum(map(_text_bytes, rows)))
        most = max(counts.items(), key=lambda kn: kn[1], default=(None, 0))
        repeated = dict(zip(keys, most[0])) if most[1] > 1 else None
    else:
        per_key = mapping.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                             F.sum(_value_bytes(mapping)).alias("b"))
        key = F.struct(*keys)
        m = per_key.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("n").alias("most"),
                        F.max_by(key, F.col("n")).alias("key")).first()
        size = (m["n"] or 0, m["b"] or 0)
        repeated = m["key"].asDict() if (m["most"] or 0) > 1 else None
    if unique and repeated is not None:
        raise ValueError(f"mapping has several rows for key {repeated}; "
                         "run validate_mapping() and fix the mapping")
    return size[0] <= max_rows and size[1] <= max_bytes


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "input") -> None:
    """Input guard: fail before planning when a needed column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}; has {df.columns}")


def _partials(measures: Sequence[Measure]) -> list[Column]:
    return [agg.alias(name) for m in measures for name, agg in m.partials]


def _partial_names(measures: Sequence[Measure]) -> list[str]:
    return [name for m in measures for name in m.partial_names()]


def _bins(measures: Sequence[Measure]) -> list[str]:
    """The bin column's name if a measure has bins (one measure at most)."""
    return [BIN for m in measures if m.binned]


def _merged(measures: Sequence[Measure]) -> list[Column]:
    return [c for m in measures for c in m.merged()]


def fact_states(facts: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Partial states of fact rows per (keys and, for a binned measure, bin)."""
    bins = _bins(measures)
    if len(bins) > 1:
        raise ValueError("one binned measure at a time")
    for m in measures:
        for columns in m.prepared:
            facts = facts.withColumns(columns)
    return facts.groupBy(*keys, *bins).agg(*_partials(measures))


def section_states(facts: DataFrame, mapping: DataFrame, keys: Sequence[str],
                   measures: Sequence[Measure], by: Sequence[str] = (),
                   unmapped: str = "keep", labels: Sequence[str] = LABELS,
                   broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                   check_keys: bool = True) -> DataFrame:
    """Partial measure states per (by, facility, section).

    Returns columns ``[*by, *labels, (bin,) *partials]``.  Fact rows whose key has no
    mapping get NULL labels (``keep``) or are excluded (``drop``).  A NULL key
    never matches.  A mapping with duplicate keys is refused (``check_keys``).
    """
    if unmapped not in ("keep", "drop"):
        raise ValueError(f"unmapped must be 'keep' or 'drop', not {unmapped!r}")
    how = "left" if unmapped == "keep" else "inner"
    keys, by, labels = list(keys), list(by), list(labels)
    require_columns(facts, [*by, *keys], "facts")
    require_columns(mapping, [*keys, *labels], "mapping")
    m = usable_keys(mapping.select(*keys, *labels), keys)
    if check_mapping(m, keys, broadcast_rows, unique=check_keys, local=mapping.isLocal()):
        joined = facts.join(F.broadcast(m), on=keys, how=how)
        return fact_states(joined, [*by, *labels], measures)
    per_key = fact_states(facts, [*by, *keys], measures)
    return merge_states(per_key.join(m, on=keys, how=how), measures, by, labels)


def merge_states(states: DataFrame, measures: Sequence[Measure], by: Sequence[str] = (),
                 labels: Sequence[str] = LABELS) -> DataFrame:
    """Merge partial states again per (by, labels, bin) (after a union)."""
    return states.groupBy(*by, *labels, *_bins(measures)).agg(*_merged(measures))


def finish_states(states: DataFrame, measures: Sequence[Measure], by: Sequence[str] = (),
                  labels: Sequence[str] = LABELS) -> DataFrame:
    """Section values from partial states: ``[*by, *labels, *measures]``.

    States of a binned measure are first brought together, one row per section."""
    if _bins(measures):
        together = [(n, agg) for m in measures for n, agg in
                    (m.gathered if m.binned else zip(m.partial_names(), m.merged()))]
        states = states.groupBy(*by, *labels).agg(*[agg.alias(n) for n, agg in together])
    return states.select(*by, *labels, *[m.section for m in measures])


def mapping_pairs(mapping: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """The distinct (facility, section) pairs a report shows.  A pair with a NULL
    section is shown (with nothing in it); one with a NULL facility is not."""
    labels = list(labels)
    return mapping.select(*labels).filter(F.col(labels[0]).isNotNull()).distinct()


def attach_pairs(frame: DataFrame, mapping: DataFrame, by: Sequence[str],
                 fill: dict[str, Column], labels: Sequence[str] = LABELS,
                 broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Add, for every period of ``frame``, one row per mapping pair.

    Few pairs (a checked number of distinct pairs, whatever the mapping's rows)
    travel as one array: the first row of each period, found by a window over the
    period's section rows, is exploded into itself plus one row per pair, so the
    frame is read in a single pass.  More pairs are joined to the distinct periods
    instead; the result is the same.  Other columns are set from ``fill`` (NULL
    when absent).
    """
    by, labels = list(by), list(labels)
    rest = [c for c in frame.columns if c not in by]
    types = {f.name: f.dataType for f in frame.schema.fields}
    pairs = mapping_pairs(mapping, labels)

    def pair_columns(get):
        return [(get(c) if c in labels else fill.get(c, F.lit(None))).cast(types[c]).alias(c)
                for c in rest]

    # there are no more pairs than mapping rows
    if not (fits_broadcast(mapping, broadcast_rows) or fits_broadcast(pairs, broadcast_rows)):
        periods = frame.select(*by).distinct()
        added = periods.crossJoin(pairs).select(*by, *pair_columns(F.col))
        return frame.select(*by, *rest).unionByName(added)
    listed = pairs.agg(F.collect_list(F.struct(*labels)).alias("pairs")).scalar()
    own = F.struct(*[F.col(c) for c in rest])
    w = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_first() for c in labels])
    first = F.row_number().over(w) == 1
    # the subquery value is projected first: a higher-order function may not hold one
    marked = frame.select("*", F.when(first, listed).alias("_pairs"))
    rows = F.when(F.col("_pairs").isNotNull(),
                  F.concat(F.array(own), F.transform(
                      F.col("_pairs"), lambda p: F.struct(*pair_columns(lambda c: p[c]))))
                  ).otherwise(F.array(own))
    return marked.select(*by, F.explode(rows).alias("_row")).select(*by, "_row.*")


def scaffold_states(states: DataFrame, mapping: DataFrame, measures: Sequence[Measure],
                    by: Sequence[str] = (), labels: Sequence[str] = LABELS,
                    broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Add every mapping pair with empty states, so each pair is reported.

    Without ``by`` the mapping's pairs are unioned once.  With ``by`` every
    period present in ``states`` gets every pair (``attach_pairs``).  The
    result is re-merged per (by, labels).  States with a NULL label are dropped
    (facts without a mapping, and facts mapped to a pair with a NULL section: that
    pair is shown, but empty, and adds nothing to its facility); they are dropped
    after the pairs are attached, so a period whose facts are all unmapped still
    gets its zero rows.
    """
    by, labels = list(by), list(labels)
    names = _partial_names(measures)
    complete = F.lit(True)
    for c in labels:
        complete = complete & F.col(c).isNotNull()
    if not by:
        types = {f.name: f.dataType for f in states.schema.fields}
        zero = [F.lit(None).cast(types[n]).alias(n) for n in [*_bins(measures), *names]]
        empty = mapping_pairs(mapping, labels).select(*labels, *zero)
        kept = states.filter(complete).unionByName(empty)
    else:
        marked = states.withColumn("_own", F.lit(True))
        carried = attach_pairs(marked, mapping, by, {"_own": F.lit(False)}, labels, broadcast_rows)
        kept = carried.filter(complete | ~F.col("_own")).drop("_own")
    # a binned measure's states come together in finish_states
    return kept if _bins(measures) else merge_states(kept, measures, by, labels)


def map_keys(facts: DataFrame, mapping: DataFrame, keys: Sequence[str],
             unmapped: str = "keep", labels: Sequence[str] = LABELS,
             broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Row-level mapping join (``left_join`` / inner); labels added to facts."""
    how = "left" if unmapped == "keep" else "inner"
    m = usable_keys(mapping.select(*keys, *labels), keys)
    fits = fits_broadcast(mapping if mapping.isLocal() else m, broadcast_rows)
    return facts.join(F.broadcast(m) if fits else m, on=list(keys), how=how)


def unmapped_keys(facts: DataFrame, mapping: DataFrame, keys: Sequence[str],
                  broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Distinct non-NULL fact keys that have no mapping row.

    ``full_join + is.na(Facility) + unique + drop_na`` is an anti join.  With
    a broadcastable mapping the anti join runs map-side and only unmapped
    keys reach the (partially aggregated) ``distinct``.  Otherwise the fact
    keys are made distinct first, so a hot key collapses map-side before the
    shuffle join with the mapping.
    """
    keys = list(keys)
    m = usable_keys(mapping.select(*keys), keys)  # an anti join needs no distinct build side
    present = facts.select(*keys).dropna(how="any", subset=keys)
    if fits_broadcast(mapping if mapping.isLocal() else m, broadcast_rows):
        return present.join(F.broadcast(m), on=keys, how="left_anti").distinct()
    return present.distinct().join(m, on=keys, how="left_anti")


def _norm_label(c: Column) -> Column:
    """Label fingerprint for drift detection: case, punctuation, spacing and a
    trailing plural ``s`` are ignored."""
    squashed = F.regexp_replace(F.lower(F.trim(c)), r"[^0-9a-z]+", "")
    return F.regexp_replace(squashed, r"s$", "")


def validate_mapping(mapping: DataFrame, keys: Sequence[str],
                     labels: Sequence[str] = LABELS) -> DataFrame:
    """Mapping problems as rows: ``issue, key, detail``.

    * ``null_key``: a key column is NULL;
    * ``blank_key``: a key column is empty or only spaces (a blank cell read as
      text would match every blank fact cell and fan out);
    * ``duplicate_key``: one key maps to more than one row;
    * ``key_variant``: keys that differ only in case or spacing (e.g.
      ``"X - SALES"`` and ``"X- SALES"``), one row per spelling with the shared
      fingerprint as detail; keys are matched exactly, so a fact spelled the
      other way stays unmapped;
    * ``label_variant``: labels written in more than one way (e.g. ``Equipment
      Service`` and ``Equipment Services``), one row per spelling.

    NULL and blank keys are one filter over the mapping.  Every other check is one
    row per mapping row and check, counted per spelling, then per fingerprint: one
    scan and two aggregations for all of them; nothing is collected.
    """
    keys, labels = list(keys), list(labels)
    key_text = F.concat_ws(" | ", *[F.col(k).cast("string") for k in keys])
    null_any = F.lit(False)
    blank_any = F.lit(False)
    for k in keys:
        null_any = null_any | F.col(k).isNull()
        blank_any = blank_any | F.coalesce(F.trim(F.col(k).cast("string")) == F.lit(""), F.lit(False))
    # NULL and blank keys in one pass over the mapping (a row can have both)
    row_issues = F.filter(F.array(F.when(null_any, F.lit("null_key")),
                                  F.when(blank_any, F.lit("blank_key"))),
                          lambda x: x.isNotNull())
    no_text = F.lit(None).cast("string")
    bad_keys = (mapping.filter(null_any | blank_any)
                .select(F.explode(row_issues).alias("issue"), key_text.alias("key"),
                        no_text.alias("detail")))
    squashed = F.regexp_replace(F.lower(key_text), r"\s+", "")
    # the duplicate check compares keys with their NULLs, so each key column is kept apart
    exact = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]),
                      {"ignoreNullFields": "false"})

    def check(name, fingerprint, spelling, when):
        return F.when(when, F.struct(F.lit(name).alias("check"), fingerprint.alias("fp"),
                                     spelling.alias("spelling")))

    checks = [check("duplicate_key", exact, key_text, F.lit(True)),
              check("key_variant", squashed, key_text, ~null_any & ~blank_any)]
    checks += [check(label, _norm_label(F.col(label)), F.col(label), F.col(label).isNotNull())
               for label in labels]
    spelled = (mapping.select(F.explode(F.array(*checks)).alias("c")).filter("c is not null")
               .groupBy("c.check", "c.fp", "c.spelling").agg(F.count(F.lit(1)).alias("n")))
    one_fp = Window.partitionBy("check", "fp")
    seen = spelled.withColumn("spellings", F.count(F.lit(1)).over(one_fp))
    is_dup = F.col("check") == "duplicate_key"
    is_key = F.col("check") == "key_variant"
    issues = (seen.filter(F.when(is_dup, F.col("n") > 1).otherwise(F.col("spellings") > 1))
              .select(F.when(is_dup | is_key, F.col("check")).otherwise("label_variant").alias("issue"),
                      F.when(is_dup | is_key, F.col("spelling")).alias("key"),
                      F.when(is_dup, F.format_string("%d rows", F.col("n")))
                       .when(is_key, F.col("fp"))
                       .otherwise(F.concat("check", F.lit(": "), "spelling")).alias("detail")))
    return bad_keys.unionByName(issues)


def label_drift(mappings: dict[str, DataFrame], label: str = "facility") -> DataFrame:
    """Labels that will not line up when reports of several populations are
    combined: ``fingerprint, label, sources, issue``, one row per spelling.

    * ``spelling``: the label's fingerprint is written in more than one way
      across the mappings;
    * ``missing``: the label is used by some mappings but not all of them.

    Works on the distinct labels of each mapping with count aggregates; the
    only gathered list is a label's sources (at most one per mapping given).
    """
    names = list(mappings)
    if not names:
        raise ValueError("no mappings given")
    labels = None
    for name in names:
        part = (mappings[name].select(F.col(label).alias("label"))
                .filter(F.col("label").isNotNull()).distinct()
                .withColumn("source", F.lit(name)))
        labels = part if labels is None else labels.unionByName(part)
    labels = labels.withColumn("fingerprint", _norm_label(F.col("label")))
    per_fp = labels.groupBy("fingerprint").agg(
        F.count_distinct("label").alias("_spellings"),
        F.count_distinct("source").alias("_sources"))
    per_label = labels.groupBy("fingerprint", "label").agg(
        F.array_join(F.sort_array(F.collect_set("source")), " | ").alias("sources"))
    issue = (F.when(F.col("_spellings") > 1, F.lit("spelling"))
             .when(F.col("_sources") < F.lit(len(names)), F.lit("missing")))
    return (per_label.join(per_fp, on="fingerprint").withColumn("issue", issue)
            .filter(F.col("issue").isNotNull())
            .select("fingerprint", "label", "sources", "issue"))
