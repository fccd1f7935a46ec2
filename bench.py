"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout.

Every query is run in full (all rows and columns produced, written nowhere), once to warm the JVM and
then $BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from registry.catalog import QUERIES  # noqa: E402
from riskloom.session import build_session  # noqa: E402

HEADLINE = [
    "features_full",
    "feat_distinct_exact",
    "features_asof",
    "entity_windows_user",
    "asof_label",
    "label_interval_join",
    "label_any",
    "upsert_events",
    "src_ecom_txn",
    "baseline_profile",
    "baseline_score",
    "top_anomalies_with_impact",
    "contributions",
    "describe_features",
    "eval_roc_auc",
    "alert_dedup",
    "state_transitions",
    "rolling_z",
    "graph_nodes",
    "window_counts_sliding",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.log.level": "ERROR"},
    )
    took: dict[str, float] = {}
    for name in names:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
