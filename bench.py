"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (3 unless set); the median
counts. With BENCH_YARDSTICK=1 the same queries' check SQL is also timed in DuckDB, on the
same machine and threads.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tillcast.plans.catalog import QUERIES
from tillcast.plans.check_sql import CHECK_SQL
from tillcast.session import local_session

HEADLINE = [
    "daily_rollup",
    "branch_totals",
    "top5_branches",
    "monthly_top5",
    "filter_range_selection",
    "enrich_weather",
    "preprocess",
    "incremental_rollup",
    "ingest_upsert",
    "stream_daily_rollup",
    "train_test_split",
    "series_forecast",
    "series_backtest",
    "mase",
    "zscore_buckets",
    "stock_min_range",
    "today_forecast",
    "ask_peak_date",
    "text_mentions",
    "fuzzy_entity_link",
]


def timed(action, runs: int) -> float:
    action()
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def duckdb_seconds(folder: str, threads: int, runs: int) -> dict[str, float]:
    import duckdb

    connection = duckdb.connect(config={"threads": threads})
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    return {
        key: timed(lambda k=key: connection.execute(CHECK_SQL[k]).fetchall(), runs)
        for key in HEADLINE
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "tillcast-bench", "16g")
    spark.sparkContext.setLogLevel("ERROR")

    def run(key: str) -> None:
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {key: timed(lambda k=key: run(k), runs) for key in HEADLINE}
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }
    if os.environ.get("BENCH_YARDSTICK"):
        result["duckdb"] = duckdb_seconds(folder, int(cpus), runs)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
