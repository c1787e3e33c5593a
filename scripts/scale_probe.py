"""Write a k-times larger copy of the report inputs, derived from the given
tables, into a fresh scratch folder (orders and lineitem replicated with
shifted keys; part unchanged, so mappings stay valid), then print its path.

usage: python scripts/scale_probe.py [src_dir] [k]
Then: BENCH_SF_DIR=<printed path> python bench.py
"""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402


def main():
    src = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    k = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    from sitetally.session import build_session
    spark = build_session(master="local[8]", shuffle_partitions=8)
    out = os.path.join(tempfile.mkdtemp(prefix="run-scale-"), f"x{k}")
    orders = spark.read.parquet(f"{src}/orders.parquet")
    n = orders.agg(F.max("o_orderkey") + 1).collect()[0][0]
    copy = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_copy")
    (orders.select("*", copy)
     .withColumn("o_orderkey", F.col("o_orderkey") + F.col("_copy") * n).drop("_copy")
     .repartition(4 * k).write.parquet(f"{out}/orders.parquet"))
    (spark.read.parquet(f"{src}/lineitem.parquet").select("*", copy)
     .withColumn("l_orderkey", F.col("l_orderkey") + F.col("_copy") * n).drop("_copy")
     .repartition(4 * k).write.parquet(f"{out}/lineitem.parquet"))
    spark.read.parquet(f"{src}/part.parquet").write.parquet(f"{out}/part.parquet")
    spark.stop()
    print(out)


if __name__ == "__main__":
    main()
