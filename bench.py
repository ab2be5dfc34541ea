"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores. Each query is
written to the noop sink, so every row and column is computed and none is sent to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from growthlens.queries import QUERIES  # noqa: E402
from growthlens.session import local_session  # noqa: E402

HEADLINE = [
    "series_features",
    "pivot_first",
    "pivot_sum",
    "dedupe_keep_first",
    "total_region_patch",
    "outer_merge_n",
    "left_feature_merge",
    "spine_fill_zero",
    "spine_interpolate",
    "interpolate_frame",
    "interpolate_order_stream",
    "lag_order_stream",
    "chrono_split",
    "quarter_split",
    "upsample_month",
    "fill_group_overall_mean",
    "fill_median",
    "zscore_outliers",
    "iqr_filter",
    "exact_quantiles",
    "profile",
    "correlation",
    "supply_demand",
    "population_metrics",
    "scenario_what_if",
    "trend_forecast",
    "backtest_metrics",
    "additive_forecast",
    "fourier_forecast",
    "rf_forecast",
    "demographics_job",
    "housing_starts_job",
    "housing_features_job",
    "education_enhance_job",
]


def run(name: str, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    for table in ("orders", "customer", "nation", "lineitem"):  # file listing and JIT, not part of any query
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.format("noop").mode("overwrite").save()
    run("pivot_first", spark, sf_dir)
    seconds = {name: run(name, spark, sf_dir) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
