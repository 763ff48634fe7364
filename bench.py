"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full with the ``noop`` sink (every row is
produced, nothing is collected to the driver). Wall time per query in
seconds; ``value`` is their sum. Session start-up is not counted, and the
JVM is warmed first by running the flagship query once on the smallest
driver tables (one-time JIT and code compilation, which a long-running
cluster pays once, would otherwise land on whichever query runs first).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from clicktrail.registry import SPARK_QUERIES, load_all  # noqa: E402
from clicktrail.session import get_spark  # noqa: E402
from clicktrail.sources.work import sweep  # noqa: E402

HEADLINE = ["sessionize", "build_forest", "tree_metrics", "build_traces", "asof_click_request", "proportions"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    shared = os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="bench-shared-")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus, checkpoint_dir=shared)
    load_all()
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        SPARK_QUERIES["session_metrics"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    else:
        spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        t0 = time.time()
        SPARK_QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        sweep(spark)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_wall",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
