"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from datetime import datetime

from pyspark.sql import SparkSession

from tidemark.model import IndexSpec
from tidemark.plans import catalog
from tidemark.session import Session
from tidemark.table import TimeSeriesTable

HEADLINE = ("range_scan_half_open", "count_sum_range", "filtered_agg_range", "group_count_range", "hourly_date_trunc", "hourly_date_bin", "coverage_runs", "max_gap_entity", "moving_avg_5", "join_inner_dim", "taxi_style_aggregate", "top_k_desc")


WEEK = "ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-12 00:00:00'"
#: The published workload's queries through a session over the managed table.
MANAGED = {
    "managed_range_scan": f"SELECT * FROM managed_events WHERE {WEEK}",
    "managed_count_sum": f"SELECT count(*) AS n, sum(value) AS total FROM managed_events WHERE {WEEK}",
    "managed_date_bin": f"SELECT date_bin(INTERVAL '1' HOUR, ts) AS hour, count(*) AS n FROM managed_events WHERE {WEEK} GROUP BY 1 ORDER BY 1",
}


def best(fn, times: int = 3) -> float:
    took = []
    for _ in range(times):
        began = time.perf_counter()
        fn()
        took.append(time.perf_counter() - began)
    return round(min(took), 4)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        run = lambda n=name: catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()
        took[name] = best(run)
    base = tempfile.mkdtemp(prefix="tidemark-bench-")
    try:
        events = catalog.table(spark, sf_dir, "events")
        table = TimeSeriesTable.create(spark, f"{base}/t", IndexSpec.timestamp("ts", "1m"))
        began = time.perf_counter()
        table.append(events.where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
        took["append_first"] = round(time.perf_counter() - began, 4)
        began = time.perf_counter()
        table.append(events.where("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
        took["append_second"] = round(time.perf_counter() - began, 4)
        session = Session(spark)
        session.register_tstable("managed_events", f"{base}/t")
        for name, sql in MANAGED.items():
            run = lambda q=sql: session.dataframe(q).write.format("noop").mode("overwrite").save()
            run()
            took[name] = best(run)
        took["coverage_ratio"] = best(lambda: table.coverage_ratio(datetime(2024, 1, 2), datetime(2024, 1, 20)))
    finally:
        shutil.rmtree(base, ignore_errors=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
