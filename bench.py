"""Times the headline queries; prints one JSON line.

Each query writes its whole result to the ``noop`` sink, so nothing is collected.
``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; names on the command
line restrict the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helio_spark.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "hourly_series row_index dedupe_first asof_align lags rolling_mean rolling_var "
    "supervised_targets covariate_fallback solar_position clearsky_ineichen solar_weights "
    "feature_table split_windows walk_forward_folds windows scale_standard persistence_forecasts "
    "metrics_by_horizon metrics_micro metrics_daylight fold_metrics align_forecasts weight_grid "
    "weight_grid_mae subset_search six_subsets_mae optimal_weights_mae latest_origin null_profile "
    "processed_store window_store gbt_horizons next_day_forecast"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("helio-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
