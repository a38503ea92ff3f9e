"""Headline queries on local cores; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from scorekit.plans.catalog import CATALOG  # noqa: E402
from scorekit.staging import local_session, staging_scope  # noqa: E402

HEADLINE = """
csv_scan_inferred csv_scan_double csv_scan_keyed csv_sink_roundtrip positional_concat group_count describe_numeric
features_consuming_train features_financial features_people features_relation scaler_fit scaler_transform
rf_predict gbt_predict holdout_predictions batch_predict train_evaluate score_people score_consuming score_fanacial
score_interaction score_relation credit_score mse pr_curve auc_pr auc_roc weighted_total array_affine map_entries_rows
factorial_column
""".split()
# A query that takes longer than this, in seconds, runs once after its warm-up instead of several times.
LONG = 20.0


def run_once(spark, name: str, sf_dir: str) -> float:
    """Seconds to plan, run and consume a query in full, with nothing sent to the driver."""
    start = time.perf_counter()
    CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    seconds, times, rows = {}, {}, {}
    for name in names:
        with staging_scope(spark):
            warm = run_once(spark, name, sf_dir)
            taken = [run_once(spark, name, sf_dir) for _ in range(runs if warm <= LONG else 1)]
            seconds[name], times[name] = round(statistics.median(taken), 3), len(taken)
            rows[name] = CATALOG[name].run(spark, sf_dir).count() if warm <= LONG else None
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name, "runs": times, "rows": rows, "cores": cores,
        "driver_memory": spark.conf.get("spark.driver.memory"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
