"""Benchmark: headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``.

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Index builds and model training are timed as their own entries; the searches
after them read the written index. Each query is run to completion with the
``noop`` sink (full execution, no driver transfer).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "search_episodes", "search_all_shows", "search_batch", "bm25_scores", "match_batch",
    "snippets", "episode_documents", "character_documents", "nb_cv_accuracy", "eval_metrics",
    "character_types", "quote_scores", "character_moments", "cosine_topk", "style_prompts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from scriptlens.plans import catalog
    from scriptlens.session import get_spark

    spark = get_spark(f"local[{cpus}]", int(cpus) * 2)
    spark.range(1000).selectExpr("sum(id)").collect()   # JVM start-up, not timed
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    timed("index_build_documents", lambda: catalog.corpus_index(spark, sf_dir, "documents"))
    timed("index_build_dialogue", lambda: catalog.corpus_index(spark, sf_dir, "dialogue"))
    timed("train_trait_model", lambda: catalog.trait_model(spark, sf_dir))
    for name in HEADLINE:
        fn = catalog.QUERIES[name]
        timed(name, lambda fn=fn: fn(spark, sf_dir).write.format("noop").mode("overwrite").save())
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
