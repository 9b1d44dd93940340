"""Write PLANS.md: per registered query, the physical join strategies,
exchange count and scanned columns (from the planned, not executed, plan).

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from helixframe.plans.queries import QUERIES, _genome  # noqa: E402
from helixframe.session import get_session  # noqa: E402

OPS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
       "CartesianProduct", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window",
       "Generate", "Union", "MapInPandas", "BatchEvalPython", "ArrowEvalPython"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(os.environ.get("MASTER", "local[8]"), shuffle_partitions=8)
    print("# Physical plans of the registered queries\n")
    print(f"Planned at `{sf_dir}` with AQE on (runtime re-planning may switch sort-merge joins to broadcast")
    print("joins when a side is measured small). Generated by `tools/plan_report.py`.")
    print("Tables that a query writes before (the genome store, distinct values behind a rank) appear as scans.\n")
    print("| query | exchanges | operators | widest scan |")
    print("| --- | --- | --- | --- |")
    _genome(spark, sf_dir)
    for name, q in QUERIES.items():
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        ops = collections.Counter()
        for op in OPS:
            ops[op] = len(re.findall(rf"\b{op}\b", plan))
        exch = len(re.findall(r"\bExchange\b", plan))
        scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
        widest = max((len(s.split(",")) for s in scans), default=0)
        desc = ", ".join(f"{k} {v}" for k, v in ops.items() if v)
        print(f"| `{name}` | {exch} | {desc} | {widest} cols |")


if __name__ == "__main__":
    main()
