"""Summarise the executed (final AQE) plan of every registered report query.

The plan tree is walked node by node, through adaptive wrappers, query stages and
scalar subqueries, so nothing of a plan with subqueries is left out.

usage: python scripts/plan_report.py [sf_dir] > PLANS.md
"""

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

JOINS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct")


def nodes(plan):
    """(class name, first line) of every node that ran."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
        return
    if name.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
        return
    yield name.removesuffix("Exec"), plan.simpleString(200)
    if name.startswith("Reused"):
        return
    for children in (plan.children(), plan.subqueries()):
        for i in range(children.size()):
            yield from nodes(children.apply(i))


def summary(df) -> dict:
    df.collect()
    found = list(nodes(df._jdf.queryExecution().executedPlan()))
    count = Counter(n for n, _ in found)
    kinds = Counter(re.sub(r".*?(hashpartitioning|SinglePartition|rangepartitioning|RoundRobin).*", r"\1", s)
                    for n, s in found if n == "ShuffleExchange")
    pushed = sorted({p for n, s in found for p in re.findall(r"PushedFilters: \[([^\]]+)\]", s)})
    return {"scans": count["FileSourceScan"], "shuffles": dict(kinds), "broadcasts": count["BroadcastExchange"],
            "reused": count["ReusedExchange"] + count["ReusedSubquery"],
            "joins": {j: count[j] for j in JOINS if count[j]}, "windows": count["Window"], "pushed": pushed,
            "python": any("Python" in n or "Pandas" in n or "Arrow" in n for n in count)}


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from sitetally.catalog import QUERIES
    from sitetally.session import build_session
    spark = build_session(master="local[8]", shuffle_partitions=8,
                          extra={"spark.sql.maxMetadataStringLength": "2000"})
    text = lambda d: ", ".join(f"{n} {k}" for k, n in sorted(d.items())) or "-"
    print("# Executed plans of the registered report queries\n")
    print(f"Generated by `scripts/plan_report.py` from the final adaptive plans at `{sf_dir}`;")
    print("scalar subqueries are counted with the query. Mapping checks and sheet indexes run as jobs")
    print("of their own before the plan and are not counted.\n")
    print("| query | file scans | shuffles | reused | broadcasts | joins | windows | pushed filters | python |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, q in QUERIES.items():
        s = summary(q(spark, sf_dir))
        print(f"| {name} | {s['scans']} | {text(s['shuffles'])} | {s['reused']} | {s['broadcasts']} | "
              f"{text(s['joins'])} | {s['windows']} | {'; '.join(s['pushed']) or '-'} | "
              f"{'yes' if s['python'] else 'no'} |")
    spark.stop()


if __name__ == "__main__":
    main()
