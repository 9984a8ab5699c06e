"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated names, or ``all`` (default: the headline set)
BENCH_RUNS     timed runs after one warm-up; the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillcast.plans.queries import QUERIES  # noqa: E402
from tillcast.session import build_session  # noqa: E402

HEADLINE = [
    "sku_performance", "sku_performance_by_part", "monthly_trends", "weekly_revenue_stats",
    "business_overview", "godown_summary", "sku_top3_godowns", "channel_summary",
    "state_channel_distribution", "kpi_report", "daily_features", "monthly_features",
    "restart_features", "predict_next_month", "predict_next_month_all", "seasonal_patterns",
    "channel_predict", "reorder_points", "ordering_schedule", "comprehensive_ordering_api",
    "key_insights", "return_rate_by_sku", "high_return_skus_p80", "high_risk_impact",
    "dedupe_sales", "shortfall", "forecast_levels", "backtest_metrics", "stream_daily_sales",
    "train_restart_model"]


def timed(run, spark, folder: str) -> float:
    start = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    picked = os.environ.get("BENCH_QUERIES", "")
    names = (list(QUERIES) if picked == "all" else
             [n for n in picked.split(",") if n] or HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(QUERIES[name], spark, folder)
        seconds[name] = round(statistics.median(
            timed(QUERIES[name], spark, folder) for _ in range(runs)), 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
