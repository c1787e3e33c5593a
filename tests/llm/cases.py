"""Small tables with the awkward cases every operator must define."""

import random

WORDS = ("the and of thn erin hean onst ably ther ingre tion with from this that over under "
         "être où naïve straße niño año").split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", str(rng.randrange(50))]) for _ in range(n))


def texts():
    """(doc_id, text): NULLs, empty, spaces, one word, copies, near copies, a very long text."""
    base = prose(150, 1)
    near = base.split()
    near[70] = "changed"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, base), (6, base), (7, " ".join(near)),
            (8, prose(90, 2) + "\n" + base), (9, prose(20_000, 3)), (10, "a b " * 400), (None, "no id here"),
            (11, prose(60, 4)), (11, prose(60, 4)), (12, "日本語のテキスト " * 20), (13, "x" * 3000)]
    return rows


SCHEMA = "doc_id long, text string"


def documents(spark, rows=None):
    """``rows`` with more columns, some of them named like an operator's own."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(texts() if rows is None else rows, SCHEMA)
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"),
                     F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("kept"),
                     F.lit(2).alias("spans"), F.lit(3).alias("__row"), F.lit(4).alias("s"),
                     F.lit(5).alias("matches"), F.lit(6).alias("quality"), F.lit(7).alias("norm"))


def one_null(values):
    return [None if v is None or v != v else v for v in values]
