"""Times the headline queries at one scale and prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores. Each query runs
once to warm up and then BENCH_RUNS times (default 1); the best run counts. Results are
written to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from shelfwise.plans.registry import all_queries

HEADLINE = (
    "latest_stock_position",
    "consumption_metrics",
    "stock_health_classification",
    "reorder_recommendations",
    "location_risk_summary",
    "item_risk_summary",
    "executive_summary",
    "stock_ledger",
    "dense_calendar",
    "stock_projection",
    "transfer_suggestions",
    "smart_recommendations",
    "stock_alerts",
    "quality_verdict",
    "duplicate_records",
    "change_captured",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfwise-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        frame = all_queries()[name](spark, sf_dir)
        frame.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    timings = {}
    for name in HEADLINE:
        run(name)
        timings[name] = round(min(run(name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
