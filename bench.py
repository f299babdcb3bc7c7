"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   table folder      (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads     (default 8)
    BENCH_RUNS     warm runs         (default 3)

Each query is planned and fully executed into the no-op sink.  ``queries``
holds the median warm time, ``cold`` the first run of each query; ``extra`` has
later additions, which the total leaves out so that it stays comparable.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelspan.plans.queries import QUERIES  # noqa: E402
from panelspan.session import tuned  # noqa: E402

HEADLINE = (
    "wide_counts", "occupation_panel", "sector_panel", "parent_rollup", "dashboard_panel",
    "national_share", "sector_wide", "crosswalk_rollup", "two_period_panel", "state_regression",
    "fe_regression", "quartile_comparison", "price_quantiles", "category_groups", "normalised_names",
    "top15_metric",
)
EXTRA = ("occupation_panel_full", "occupation_wide_full", "regression_refresh", "slice_batch", "category_dictionary")


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = tuned(
        SparkSession.builder.master(f"local[{cpus}]").appName("panelspan-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in (*HEADLINE, *EXTRA):
        cold[name] = round(run(spark, name, folder), 3)
        warm[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    extra = {name: warm.pop(name) for name in EXTRA}
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "extra": extra, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
