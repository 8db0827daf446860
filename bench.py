"""Headline-query benchmark.

Runs the headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1)
with local[$BENCH_CPUS] and prints one JSON line.  Each query is executed
in full with a no-op sink (no collect to the driver), after one warm-up
run of the scoring pipeline so JVM start-up and JIT compilation are not
charged to the first measured query.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans import catalog  # noqa: E402
from riskloom.session import build_session  # noqa: E402

HEADLINE = [
    "feature_base", "rfm_scores", "predictions", "segment_summary", "overview_stats",
    "top_at_risk", "upsert_customers", "backfill_merge", "roc_auc", "describe",
]


def run(spark, key: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = catalog.QUERIES[key](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    run(spark, "predictions", sf_dir)  # warm-up (JIT), not reported
    times = {k: round(run(spark, k, sf_dir), 3) for k in keys}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
