"""Multi-party chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and all others as named users::

    <|assistant|>\\n{text}<|end|>\\n           a turn of the speaker
    <|user name={role}|>\\n{text}<|end|>\\n    a turn of anyone else

``mask`` lists the spans to train on, ``start-end`` in code points of the
rendering, comma-joined: each of the speaker's texts with its end mark.

Scale: rows are shuffled once, by conversation; participants come out of the
same group.  A conversation of more than ``whole_turns`` rows is rendered in
parts of at most that many rows instead (column ``part``; the rendering is the
parts in order and a part's mask counts from the part's start), so no group is
larger, however hot the conversation.  With ``whole`` the parts of a participant,
a thousandth of the turns, are joined to one row like any other (``part`` 0, masks
from the rendering's start); a row's task then holds one rendering, and Spark's
limit of 2 GB a value holds for it.  The list of such conversations is
broadcast while it has at most ``BROADCAST_ROWS`` rows and joined otherwise.

Defined cases: a NULL conv_id is one conversation; a NULL turn comes first; a
NULL role is the participant ``unknown``; a NULL text is empty; rows of one turn
are ordered by role, then text; repeated rows are all rendered; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

WHOLE_TURNS = 1024
BROADCAST_ROWS = 100_000
END = "<|end|>\n"


def _head(role: Column, speaker: Column) -> Column:
    return F.when(role == speaker, F.lit("<|assistant|>\n")).otherwise(
        F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def _mask(turns: Column, speaker: Column) -> Column:
    """Spans of the speaker's turns, by a running position over the ordered turns."""
    empty = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<string>").alias("spans"))

    def step(acc, turn):
        start = acc["at"] + F.length(_head(turn["role"], speaker))
        stop = start + F.length(turn["text"]) + len(END)
        span = F.concat_ws("-", start.cast("string"), (stop - 1).cast("string"))
        return F.struct(stop.cast("long").alias("at"),
                        F.when(turn["role"] == speaker, F.concat(acc["spans"], F.array(span)))
                         .otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda acc: F.array_join(acc["spans"], ","))


def _render(parts: DataFrame) -> DataFrame:
    """Rows of (conv_id, part, speakers, turns) to one row per speaker."""
    rows = parts.select("conv_id", "part", F.explode("speakers").alias("speaker"), "turns")
    speaker = F.col("speaker")
    own = F.filter("turns", lambda t: t["role"] == speaker)
    text = F.array_join(F.transform("turns", lambda t: F.concat(
        _head(t["role"], speaker), t["text"], F.lit(END))), "")
    masked = F.aggregate(own, F.lit(0).cast("long"),
                         lambda acc, t: acc + F.length(t["text"]) + (len(END) - 1))
    return rows.select(
        "conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"),
        F.size(own).cast("long").alias("n_own_turns"), masked.alias("n_masked"),
        _mask(F.col("turns"), speaker).alias("mask"), text.alias("text"))


def _gathered() -> Column:
    return F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")


def rotate(turns: DataFrame, whole_turns: int = WHOLE_TURNS,
           broadcast_rows: int = BROADCAST_ROWS, whole: bool = False) -> DataFrame:
    """One rendering per conversation and participant, long ones in parts unless ``whole``."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    long_ones = (rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > whole_turns)
                     .select(F.col("conv_id").alias("long_id")))
    n_long = long_ones.limit(broadcast_rows + 1).count()
    if n_long == 0:
        return _render(_whole(rows))
    listed = F.broadcast(long_ones) if n_long <= broadcast_rows else long_ones
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    parts = _render(_in_parts(rows.join(listed, same, "left_semi"), whole_turns))
    return _render(_whole(rows.join(listed, same, "left_anti"))).unionByName(
        _joined(parts) if whole else parts)


def _whole(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id").agg(_gathered(), F.sort_array(F.collect_set("role")).alias("speakers")) \
        .withColumn("part", F.lit(0).cast("long"))


def _in_parts(rows: DataFrame, whole_turns: int) -> DataFrame:
    """Long conversations, cut where a sorted range partition has ``whole_turns`` rows."""
    order = ["conv_id", "turn", "role", "text", "tie"]
    placed = (rows.withColumn("tie", F.monotonically_increasing_id())
                  .repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("at", F.monotonically_increasing_id()))
    # the upper bits of ``at`` are the partition, the lower 33 count its rows
    part = F.col("at") - F.pmod("at", F.lit(whole_turns))
    cut = placed.withColumn("part", part).groupBy("conv_id", "part").agg(_gathered())
    speakers = rows.groupBy(F.col("conv_id").alias("long_id")).agg(
        F.sort_array(F.collect_set("role")).alias("speakers"))
    return cut.join(speakers, F.col("conv_id").eqNullSafe(F.col("long_id"))).drop("long_id")


def _joined(parts: DataFrame) -> DataFrame:
    """Parts of a rendering to one row, spans moved by the parts before."""
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = parts.withColumn("at", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    spans = F.transform(F.split("mask", ","), lambda span: F.array_join(
        F.transform(F.split(span, "-"), lambda x: (x.cast("long") + F.col("at")).cast("string")), "-"))
    moved = placed.withColumn("mask", F.when(F.col("mask") != "", F.array_join(spans, ",")))
    listed = F.sort_array(F.collect_list(F.struct("part", "mask", "text")))
    totals = [F.sum(c).alias(c) for c in ("n_turns", "n_own_turns", "n_masked")]
    return moved.groupBy("conv_id", "speaker").agg(*totals, listed.alias("parts")).select(
        "conv_id", "speaker", F.lit(0).cast("long").alias("part"), "n_turns", "n_own_turns", "n_masked",
        F.array_join("parts.mask", ",").alias("mask"), F.array_join("parts.text", "").alias("text"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every perspective of every conversation."""
    return rotate(read_table(spark, sf_dir, "conversations"), whole=True)


OP3_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), s AS (
  SELECT t.conv_id, p.speaker, t.turn, t.role, t.text,
         CASE WHEN t.role = p.speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || t.role || '|>' || chr(10) END AS head
  FROM t JOIN (SELECT DISTINCT conv_id, role AS speaker FROM t) p
    ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), w AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS seg,
         coalesce(sum(length(head) + length(text) + 8) OVER (
           PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM s
)
SELECT conv_id, speaker, CAST(0 AS BIGINT) AS part, count(*) AS n_turns,
       count(*) FILTER (WHERE role = speaker) AS n_own_turns,
       CAST(sum(length(text) + 7) FILTER (WHERE role = speaker) AS BIGINT) AS n_masked,
       string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(text) + 7 AS BIGINT), ','
                  ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = speaker) AS mask,
       string_agg(seg, '' ORDER BY turn NULLS FIRST, role, text) AS text
FROM w GROUP BY conv_id, speaker
"""
