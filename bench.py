"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric": ..., "value": total seconds, "unit": "sec",
"queries": {name: seconds}, "sf": ...}. Each query is executed in full with the
``noop`` sink (no collect), after one small warm-up query that starts the JVM and
the Python workers.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ratings",
    "item_histogram",
    "item_stats",
    "zscore_mse",
    "user_vectors",
    "similar_items_exact",
    "recommend",
    "study_mse",
    "kde_nll",
    "kernel_features",
    "kernel_sweep",
    "posterior_sample",
    "als_normalized",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from ratinglab.session import build_session
    from ratinglab.plans.queries import queries

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    # warm-up: JVM, codegen paths and a Python worker
    qs["item_pmf"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
