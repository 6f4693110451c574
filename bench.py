"""Headline query timings: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Each query runs to completion into the no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "rtm_hourly_multi", "backfill_15min_avg", "upsert_last_write", "distinct_keep_last", "fuel_mw_hourly", "asof_hourly_to_15min",
    "merge_api_over_cdr", "pivot_day_slots", "spike_price_features", "rtm15_rolling", "label_all_points", "unified_features",
    "spike_feature_matrix", "delta_samples", "dam_daily_features", "backtest_metrics", "running_drawdown", "risk_metrics",
    "curtailment_schedule", "battery_rule_schedule", "roc_pr_auc", "audit_duplicates", "price_statistics", "stream_tumbling_15min",
]


def main() -> None:
    from gridtide.catalog import REGISTRY
    from gridtide.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "gridtide-bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        start = time.perf_counter()
        REGISTRY[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
