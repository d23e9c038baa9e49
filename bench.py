"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the cores. Every query
runs once to warm up and then twice; the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallyscope.plans.all_queries import QUERIES
from tallyscope.session import local_session

HEADLINE = [
    "e1_ledger_transactions",
    "f13_all_features",
    "f5_avg_holding_duration_estimate_py",
    "f11_value_velocity_py",
    "m1_account_sample",
    "m5_behavioural_features",
    "m6_feature_mart",
    "l8_label_table",
    "r4_registry_counts",
    "c5_account_context",
    "v1_similar_accounts",
    "v5_density_clusters",
    "v9_silhouettes",
    "v9_fast_silhouettes",
    "v13_cluster_profiles",
    "t5_stratified_split",
    "d4_weight_search",
    "d5_class_report",
    "a8_feature_statistics",
    "q1_not_null",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "tallyscope-bench")
    times = {}
    for name in names:
        best = None
        for attempt in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            if attempt:
                best = taken if best is None else min(best, taken)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
