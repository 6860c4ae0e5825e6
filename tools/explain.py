"""Print the formatted physical plan of registered queries.

Usage: python tools/explain.py [sf_dir] [name ...]

Prints ``explain("formatted")`` per query followed by a one-line summary of
the operators that matter at scale: scans with their pushed filters, joins by
strategy, exchanges and per-group limits.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WATCH = ["Scan parquet", "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct", "Exchange", "WindowGroupLimit", "HashAggregate", "MapInPandas"]


def main() -> None:
    from scriptlens.plans import catalog
    from scriptlens.session import get_spark

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or ["search_episodes", "bm25_scores", "match_batch", "character_types",
                             "nb_cv_accuracy", "cosine_topk"]
    spark = get_spark("local[8]", 8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "400")
    for name in names:
        df = catalog.QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        print(f"===== {name}")
        print(plan)
        ops = Counter()
        for line in plan.splitlines():
            for w in WATCH:
                if re.match(r"^\(\d+\) " + re.escape(w), line.strip()):
                    ops[w] += 1
        print(f"----- {name} summary: " + ", ".join(f"{k}={v}" for k, v in sorted(ops.items())))


if __name__ == "__main__":
    main()
