"""Benchmark the headline report queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; every run executes the whole plan through the ``noop``
sink (nothing is collected).  One warm-up run, then the median of
$BENCH_REPS (default 5) timed runs.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "nonexempt_report",
    "exempt_report",
    "hours_report",
    "incident_report",
    "combined_report",
    "unmapped_keys",
    "label_alerts",
    "expenditure_by_center",
    "hours_report_by_period",
    "incident_report_by_period",
    "mapping_violations",
    "sheet_header_footer",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "5"))
    names = sys.argv[1:] or list(HEADLINE)
    from sitetally.catalog import QUERIES
    from sitetally.session import build_session
    spark = build_session(master=f"local[{cpus}]", app="sitetally-bench",
                          shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "16g"})
    times = {}
    for name in names:
        q = QUERIES[name]
        run(q(spark, sf_dir))
        samples = []
        for _ in range(reps):
            t0 = time.perf_counter()
            run(q(spark, sf_dir))
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "report_queries_total_median", "value": round(sum(times.values()), 4),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
