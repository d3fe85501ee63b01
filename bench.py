"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans.catalog import QUERIES
from tidemark.session import configure

HEADLINES = [
    "resample_daily",
    "resample_weekly",
    "describe_basic",
    "describe_quartiles",
    "scan_text_sorted",
    "nested_customer_orders",
    "rolling_mean_52",
    "decompose_resid",
    "adf_autolag",
    "adf_suppliers",
    "forecast_ar1_d1",
    "forecast_ma1_d1",
    "forecast_arima_211",
    "forecast_suppliers_ar1",
    "forecast_suppliers_211",
    "grid_search_rmse",
    "best_order_suppliers",
    "model_comparison",
    "forecast_additive",
    "predicted_vs_expected",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        configure(SparkSession.builder).master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    # Start the Python workers and load the classes before the clock runs.
    QUERIES["forecast_arima_211"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
