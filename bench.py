"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then ``BENCH_REPEAT`` times; the median counts. Every run computes the whole result
(written to Spark's no-op sink), from the source tables on.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES
from tollgate.session import build_session

HEADLINE = [
    "flagship_train_eval_gate", "stratified_split", "batch_score", "roc_auc_exact", "comparison_metrics", "comparison_one_pass",
    "roc_auc_by_segment", "dq_gate", "column_profile", "smote_exact", "forest_train_score", "request_defaults",
    "stream_score", "promotion_gate", "rollback_plan", "export_manifest", "lineage_trace", "run_alert_rows", "drift_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
