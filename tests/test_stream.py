"""The streamed rollup against the batch rollup, with late rows and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillcast.session import run_dir
from tillcast.streaming import daily_rollup as stream

LINES = "ts timestamp_ntz, item string, qty double"
TOTALS = "date date, item string, qty_sold double"
D = dt.date.fromisoformat


def write(spark, folder, *data):
    rows = [(dt.datetime.fromisoformat(t), i, q) for t, i, q in data]
    spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def run(spark):
    source, sink = run_dir(spark, "test-source"), run_dir(spark, "test-sink")

    def feed(*data):
        write(spark, source, *data)
        lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(source)
        totals = stream.stream_rollup(lines, "ts", ["item"], F.col("qty"))
        stream.start(totals, sink).awaitTermination()
        return stream.current_totals(spark, sink, TOTALS)

    return feed


def test_later_batches_update_totals(run, rows):
    assert rows(run(("2024-01-01 10:00", "a", 1.0), ("2024-01-01 11:00", "b", 2.0))) == [
        (D("2024-01-01"), "a", 1.0), (D("2024-01-01"), "b", 2.0)]
    got = run(("2024-01-01 23:59", "a", 4.0), ("2024-01-02 00:00", "a", 8.0))
    assert rows(got) == [
        (D("2024-01-01"), "a", 5.0), (D("2024-01-01"), "b", 2.0), (D("2024-01-02"), "a", 8.0)]


def test_the_day_before_is_taken_in_and_older_days_are_late(run, rows):
    run(("2024-01-20 10:00", "a", 1.0))
    got = run(("2024-01-19 10:00", "a", 2.0), ("2024-01-18 10:00", "a", 64.0))
    assert rows(got) == [(D("2024-01-19"), "a", 2.0), (D("2024-01-20"), "a", 1.0)]


def test_ordered_stream_equals_batch(spark, run, rows):
    data = [(f"2024-02-{1 + n // 10:02d} {n % 10:02d}:00", f"i{n % 3}", float(n)) for n in range(100)]
    got = None
    for start in range(0, 100, 35):
        got = run(*data[start:start + 35])
    batch = (
        spark.createDataFrame([(dt.datetime.fromisoformat(t), i, q) for t, i, q in data], LINES)
        .groupBy(F.to_date("ts").alias("date"), "item").agg(F.sum("qty").alias("qty_sold")))
    assert rows(got) == rows(batch)


def test_a_batch_run_twice_counts_once(spark, rows):
    sink = run_dir(spark, "test-sink")
    store = stream.totals_store(spark, sink, TOTALS)
    stream.upsert(spark.createDataFrame([(D("2024-02-01"), "b", 1.0)], TOTALS), store)
    batch = spark.createDataFrame([(D("2024-01-01"), "a", 3.0)], TOTALS)
    for _ in range(2):
        stream.upsert(batch, store)
    assert rows(stream.current_totals(spark, sink, TOTALS)) == [
        (D("2024-01-01"), "a", 3.0), (D("2024-02-01"), "b", 1.0)]
