"""The sales stream: replayed batches, late lines, lost commits, and equality with the batch job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillcast.operators.lookup import map_branches
from tillcast.plans.ingest import refresh_enriched
from tillcast.session import run_dir
from tillcast.sources import schemas
from tillcast.sources.enriched_store import EnrichedStore
from tillcast.streaming import sales_stream

FIRST = dt.date(2024, 1, 20)


@pytest.fixture
def tables(spark):
    branch_map = spark.createDataFrame(
        [("W1", "north"), ("W2", "north"), ("W3", "south")], "code string, branch string")
    places = spark.createDataFrame(
        [("north", "A", 1.0, 2.0), ("south", "B", 3.0, 4.0)],
        "branch string, city string, latitude double, longitude double")
    weather = spark.createDataFrame(
        [(FIRST + dt.timedelta(days=n), 1.0, 2.0, float(n), 5.0) for n in range(30)],
        schemas.WEATHER)
    return branch_map, places, weather


def lines(spark, days):
    found = [(dt.datetime.combine(FIRST + dt.timedelta(days=n), dt.time(8 + k)), "cakes", "plain", w,
              float(1 + (n + k) % 3)) for n in days for k, w in enumerate(("W1", "W2", "W3", "W9"))]
    return spark.createDataFrame(found, schemas.INVOICE_ITEM)


def store(spark, label="test-stream"):
    return EnrichedStore(spark, run_dir(spark, label))


def add(spark, tables, kept, days, batch):
    branch_map, places, weather = tables
    sales_stream.commit(map_branches(lines(spark, days), branch_map), batch, places, weather, kept)


def test_batches_give_what_the_batch_job_gives(spark, tables, rows):
    kept, whole = store(spark), store(spark)
    add(spark, tables, kept, range(8), 0)
    add(spark, tables, kept, range(7, 16), 1)  # the last day again: new lines of that day
    add(spark, tables, kept, range(7, 16), 1)  # replayed
    every = lines(spark, [*range(8), *range(7, 16)])
    refresh_enriched(every, *tables, whole)
    assert rows(kept.read()) == rows(whole.read())
    assert rows(kept.statistics.read()) == rows(whole.statistics.read())
    assert rows(kept.ledger(), "batch", "n_lines", "n_late") == [(0, 32, 0), (1, 36, 0)]


def test_late_lines_are_kept_apart_and_counted(spark, tables, rows):
    kept = store(spark)
    add(spark, tables, kept, range(10), 0)
    before = rows(kept.read())
    add(spark, tables, kept, [2, 3], 1)
    assert rows(kept.read()) == before
    add(spark, tables, kept, [7, 8, 10], 2)  # day 8 is within the look-back of day 9
    assert rows(kept.ledger(), "batch", "n_lines", "n_late") == [(0, 40, 0), (1, 8, 8), (2, 12, 4)]
    late = kept.late_lines().groupBy("batch").agg(F.count(F.lit(1)), F.sum("qty"))
    assert rows(late) == [(1, 8, 15.0), (2, 4, 8.0)] or rows(late, "batch") == [(1,), (2,)]
    assert kept.read().filter(F.col("date") == F.lit(FIRST + dt.timedelta(days=10))).count() == 3
    total = kept.read().agg(F.sum("qty_sold")).first()[0]
    sent = lines(spark, [*range(10), 2, 3, 7, 8, 10]).agg(F.sum("qty")).first()[0]
    assert total + kept.late_lines().agg(F.sum("qty")).first()[0] == sent


def test_a_batch_lost_after_staging_is_finished_once(spark, tables, rows, monkeypatch):
    kept = store(spark)
    add(spark, tables, kept, range(5), 0)
    finish = EnrichedStore.finish
    monkeypatch.setattr(EnrichedStore, "finish", lambda self, staging: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        add(spark, tables, kept, range(5, 9), 1)
    assert not kept.has_batch(1)
    monkeypatch.setattr(EnrichedStore, "finish", finish)
    add(spark, tables, kept, range(5, 9), 1)  # the engine runs the batch again
    whole = store(spark)
    refresh_enriched(lines(spark, range(9)), *tables, whole)
    assert rows(kept.read()) == rows(whole.read())
    assert rows(kept.ledger(), "batch") == [(0,), (1,)]


def test_stream_goes_on_where_it_ended(spark, tables, rows):
    branch_map, places, weather = tables
    kept, folder = store(spark), run_dir(spark, "test-lines")
    for days in (range(6), [6, 7], []):
        if days:
            lines(spark, days).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(schemas.INVOICE_ITEM).parquet(folder)
        sales_stream.start(arriving, branch_map, places, weather, kept).awaitTermination()
    assert rows(kept.ledger(), "batch", "n_lines") == [(0, 24), (1, 8)]
    whole = store(spark)
    refresh_enriched(lines(spark, range(8)), *tables, whole)
    assert rows(kept.read()) == rows(whole.read())
