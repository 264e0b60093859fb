"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Every query is fully executed with the no-op sink (no collect to the driver)
after a warm-up on the smallest tables; caches are cleared before each query,
so every query runs cold. The value is the sum of the per-query wall times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.session import get_spark  # noqa: E402
from riskloom.plans.queries import Q, clear_caches  # noqa: E402

HEADLINE = [
    "FEATURES_table",
    "V13_location_report",
    "E4_target_encoding",
    "D1_split",
    "D2_standardize",
    "L6_threshold_search",
    "L7_threshold_profiles",
    "V1_metrics",
    "V4_roc_curve",
    "K1_knn_minority",
    "B2_adasyn",
    "L1_logistic_regression",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    scratch = tempfile.mkdtemp(prefix="riskloom-bench-")
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                      extra={"spark.driver.memory": "16g",
                             "spark.local.dir": scratch})
    # warm-up: the same code paths on the smallest tables (JIT, codegen caches)
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for n in ("FEATURES_table", "V1_metrics"):
        Q[n](spark, warm_dir if os.path.isdir(warm_dir) else sf_dir) \
            .write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        # each query starts cold: no cached tables or models from earlier ones
        spark.catalog.clearCache()
        clear_caches()
        t0 = time.time()
        Q[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(f"{n}: {times[n]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
