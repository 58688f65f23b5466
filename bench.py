"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "population_colours", "envelope_rules", "permanent_exits", "population_overlap", "peak_search", "greedy_colour_pairs",
    "interpolate_at_visits", "multi_percentile_profiles", "latitude_cut_scan", "smoothed_parameter_grid", "depth_quantile_table",
    "cone_search_visits", "snia_broker_export", "efficiency_summary",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096").config("spark.log.level", "ERROR")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    from skyhue.plans import catalog

    names = wanted.split(",") if wanted else HEADLINE
    times = {}
    for name in names:
        spent = []
        for _ in range(1 + runs):  # the first one warms up
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent[1:]), 3)
        print(f"{name} first {spent[0]:.2f} then {times[name]:.2f}", file=sys.stderr, flush=True)
    label = os.path.basename(sf.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(label)}))


if __name__ == "__main__":
    main()
