"""Summarize the physical plan of every catalogue query into PLANS.md.

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md
The plans are the adaptive plans before execution: of the frame that a query
returns, and of every table that it writes while it is built (hits, positions,
state tables), which the counts include.
"""

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql.readwriter import DataFrameWriter  # noqa: E402

from vigilspark.plans.catalogue import QUERIES  # noqa: E402
from vigilspark.session import get_session  # noqa: E402

PATTERNS = [
    ("shuffles", r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition"),
    ("SMJ", r"SortMergeJoin"),
    ("BHJ", r"BroadcastHashJoin"),
    ("BNLJ", r"BroadcastNestedLoopJoin"),
    ("cartesian", r"CartesianProduct"),
    ("windows", r"\bWindow \["),
    ("pandas", r"FlatMapGroupsInPandas|MapInPandas"),
    ("row UDF", r"BatchEvalPython"),
    ("top-k", r"TakeOrderedAndProject"),
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    written, parquet = [], DataFrameWriter.parquet

    def noted(self, *args, **kw):
        written.append(plan_of(self._df))
        return parquet(self, *args, **kw)

    DataFrameWriter.parquet = noted
    print("# Physical plans of the catalogue queries\n")
    print(f"Generated by `scripts/plan_report.py` on `{sf}` (adaptive plans before execution; "
          "AQE may still turn a sort-merge join into a broadcast at runtime).  Counts are sums over the returned frame and the "
          "tables written while the query is built.\n")
    print("| query | tables written | " + " | ".join(p for p, _ in PATTERNS) + " | pushed filters on source scans |")
    print("|---|" + "---|" * (len(PATTERNS) + 2))
    for name, fn in QUERIES.items():
        written.clear()
        plan = plan_of(fn(spark, sf))
        jobs, plan = len(written), "\n".join([plan, *written])
        counts = [str(len(re.findall(rx, plan))) for _, rx in PATTERNS]
        pushed = sorted({m for m in re.findall(r"PushedFilters: \[([^\]]+)\]", plan)})
        pushed = "; ".join(pushed)[:120] if pushed else "-"
        print(f"| {name} | {jobs} | " + " | ".join(counts) + f" | {pushed} |")


if __name__ == "__main__":
    main()
