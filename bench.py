"""Timings of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables and BENCH_CPUS the local cores. Every query is run
in full into a sink that discards rows, after a warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from catalog import QUERIES  # noqa: E402

HEADLINES = (
    "source_test_days",
    "qualifying_records",
    "qualifying_records_percent_rank",
    "filled_forward_first",
    "lactation_records",
    "smoothed_components",
    "median_curve",
    "records_with_quartile",
    "day_points",
    "fit_herd_and_groups",
    "fit_median_curve",
    "fit_lactations",
    "fit_outcomes",
    "individual_scale",
    "yields_305",
    "losses_by_group",
    "grid_search",
    "grid_search_by_loss",
    "global_search",
    "group_model_yields",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINES
    folder = tempfile.mkdtemp(prefix="lactoscope-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lactoscope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["fit_herd_and_groups"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
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


if __name__ == "__main__":
    main()
