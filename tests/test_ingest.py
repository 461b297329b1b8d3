"""Rollup, branch mapping, upsert and the stored fact."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tillcast.operators import lookup, rollup, stock
from tillcast.plans.ingest import refresh
from tillcast.session import run_dir
from tillcast.sources import schemas
from tillcast.sources.fact_store import FactStore

MAP = [("W1", "north"), ("W2", "north"), ("W3", "south")]


@pytest.fixture
def branch_map(spark):
    return spark.createDataFrame(MAP, "code string, branch string")


def lines(spark, *data):
    rows = [(dt.datetime.fromisoformat(d), g, i, w, q) for d, g, i, w, q in data]
    return spark.createDataFrame(rows, schemas.INVOICE_ITEM)


def day(text):
    return dt.date.fromisoformat(text)


def test_two_codes_of_one_branch_are_summed(spark, branch_map, rows):
    sold = lines(
        spark,
        ("2024-01-01 09:00", "cakes", "plain", "W1", 2.0),
        ("2024-01-01 18:30", "cakes", "plain", "W2", 3.0),
        ("2024-01-02 00:00", "cakes", "plain", "W1", 1.0),
    )
    expected = [
        (day("2024-01-01"), "north", "cakes", "plain", 5.0),
        (day("2024-01-02"), "north", "cakes", "plain", 1.0),
    ]
    once = rollup.sales_daily(sold, branch_map)
    assert rows(once) == expected
    twice = rollup.resum(lookup.map_branches(rollup.daily_rollup(sold), branch_map))
    assert rows(twice) == expected


def test_unknown_code_passes_through_and_null_stays(spark, branch_map, rows):
    df = spark.createDataFrame([("W9", 1), (None, 2), ("W3", 3)], "warehouse string, n int")
    mapped = lookup.map_branches(df, branch_map)
    assert rows(mapped, "branch", "n") == [("W9", 1), ("south", 3), (None, 2)] or rows(
        mapped, "branch", "n"
    ) == sorted([("W9", 1), ("south", 3), (None, 2)], key=str)
    chosen = spark.createDataFrame([("NORTH",), ("east",)], "branch string")
    assert rows(lookup.unknown_branches(chosen, branch_map)) == [("east",)]
    codes = lookup.codes_of_branches(branch_map, ["North"])
    assert rows(codes, "code") == [("W1",), ("W2",)]


def test_item_sold_in_two_groups_keeps_both(spark, branch_map, rows):
    sold = lines(
        spark,
        ("2024-01-01", "cakes", "plain", "W1", 2.0),
        ("2024-01-01", "gifts", "plain", "W1", 3.0),
    )
    daily = rollup.sales_daily(sold, branch_map)
    merged = rollup.upsert_last(daily, daily)
    assert rows(merged, "item_group", "qty_sold") == [("cakes", 2.0), ("gifts", 3.0)]


def test_upsert_new_row_wins_and_is_idempotent(spark, rows):
    stored = spark.createDataFrame(
        [(day("2024-01-01"), "north", "cakes", "plain", 1.0),
         (day("2024-01-01"), "north", "cakes", "rich", 4.0)], schemas.SALES)
    batch = spark.createDataFrame(
        [(day("2024-01-01"), "north", "cakes", "plain", 9.0)], schemas.SALES)
    once = rollup.upsert_last(stored, batch)
    assert rows(once, "item_name", "qty_sold") == [("plain", 9.0), ("rich", 4.0)]
    assert rows(rollup.upsert_last(once, batch)) == rows(once)


def test_refresh_rewrites_only_touched_months(spark, branch_map, rows):
    store = FactStore(spark, run_dir(spark, "test-store"))
    assert store.read_if_exists() is None
    old = [
        ("2024-01-10", "cakes", "plain", "W1", 1.0),
        ("2024-02-03", "cakes", "plain", "W1", 2.0),
    ]
    assert refresh(lines(spark, *old), branch_map, store)
    assert store.high_water_mark(store.read()) == day("2024-02-03")
    january = {r[0] for r in store.read().filter("month = '2024-01'")
               .select(F.input_file_name()).collect()}
    new = [
        ("2024-01-11", "cakes", "plain", "W1", 50.0),  # older than the look-back: not read
        ("2024-02-02", "cakes", "late", "W2", 5.0),
        ("2024-02-03", "cakes", "plain", "W1", 3.0),
        ("2024-03-01", "cakes", "plain", "W3", 4.0),
    ]
    assert refresh(lines(spark, *old[:1], *new), branch_map, store)
    expected = [
        (day("2024-01-10"), "north", "plain", 1.0),
        (day("2024-02-02"), "north", "late", 5.0),
        (day("2024-02-03"), "north", "plain", 3.0),
        (day("2024-03-01"), "south", "plain", 4.0),
    ]
    columns = ("date", "branch", "item_name", "qty_sold")
    assert rows(store.read(), *columns) == expected
    assert january == {r[0] for r in store.read().filter("month = '2024-01'")
                       .select(F.input_file_name()).collect()}
    # the same lines again change nothing; no lines at all write nothing
    refresh(lines(spark, *old[:1], *new), branch_map, store)
    assert rows(store.read(), *columns) == expected
    assert not refresh(lines(spark, *new).filter("false"), branch_map, store)


@pytest.mark.parametrize("whole", [True, False])
def test_a_lost_run_is_finished_or_undone(spark, branch_map, rows, whole):
    store = FactStore(spark, run_dir(spark, "test-store"))
    refresh(lines(spark, ("2024-01-10", "cakes", "plain", "W1", 1.0)), branch_map, store)
    staged = [(day("2024-01-10"), "north", "cakes", "plain", 7.0, "2024-01")]
    left = f"{store.path}_staging/left"
    (spark.createDataFrame(staged, store.schema).write.partitionBy("month")
     .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", whole).parquet(left))
    store.recover()
    assert rows(store.read(), "qty_sold") == [(7.0 if whole else 1.0,)]
    with pytest.raises(AnalysisException):
        spark.read.parquet(left)


def test_mapping_keeps_the_total(spark, branch_map):
    sold = lines(spark, *[
        (f"2024-01-{1 + n % 28:02d}", f"g{n % 3}", f"i{n % 7}", f"W{n % 5}", float(n % 11))
        for n in range(500)
    ])
    total = sold.agg(F.sum("qty")).first()[0]
    assert rollup.sales_daily(sold, branch_map).agg(F.sum("qty_sold")).first()[0] == total


def test_dedup_first_goes_by_the_stated_order(spark, rows):
    df = spark.createDataFrame(
        [("n", "i", "b", 2), ("n", "i", "a", 1), ("n", "j", "c", 3)],
        "branch string, item_name string, item_group string, qty int")
    first = rollup.dedup_first(df, ["branch", "item_name"], ["item_group"])
    assert rows(first) == [("n", "i", "a", 1), ("n", "j", "c", 3)]


def test_hot_key_sends_one_row_per_task(spark, branch_map):
    """A third of all lines on one key: the map side sums them before the shuffle."""
    hot = spark.range(0, 300000, 1, 8).select(
        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("creation"),
        F.lit("cakes").alias("item_group"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("i"), F.col("id") % 50)).alias("item_name"),
        F.lit("W1").alias("warehouse"),
        F.lit(1.0).alias("qty"))
    daily = rollup.sales_daily(hot, branch_map)
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    assert daily.filter("item_name = 'hot'").first()["qty_sold"] == 100000.0


def test_repeated_codes_count_without_a_row_each(spark):
    """A code that is in the map 50 times counts 50 times, but no line is met that often."""
    sold = spark.createDataFrame(
        [("2024-01-01 10:00:00", "g", "i", "w", 2.0), ("2024-01-01 11:00:00", "g", "i", "v", 1.0)],
        "creation string, item_group string, item_name string, warehouse string, qty double",
    ).withColumn("creation", F.col("creation").cast("timestamp_ntz"))
    repeated = spark.createDataFrame([("w", "b")] * 50 + [("w", "c"), (None, "d")], "code string, branch string")
    found = {r["branch"]: r["qty_sold"] for r in rollup.sales_daily(sold, repeated).collect()}
    assert found == {"b": 100.0, "c": 2.0, "v": 1.0}
    met = lookup.map_branches_counted(sold, repeated)
    assert sorted((r["branch"], r["copies"]) for r in met.collect()) == [("b", 50), ("c", 1), ("v", 1)]


def test_months_of_moves_lie_by_month_and_are_looked_up_by_keys(spark):
    moves = spark.createDataFrame(
        [("2024-01-03", 1, 7, 2.0), ("2024-01-09", 1, 7, 3.0), ("2024-01-09", 2, 7, 1.0), ("2024-02-01", 1, 7, 5.0), ("2024-02-01", None, 7, 4.0)],
        "date string, warehouse_key bigint, item_code bigint, moved double",
    ).withColumn("date", F.col("date").cast("date"))
    months = stock.month_moves(moves)
    assert months._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    store = FactStore(spark, run_dir(spark, "moves"), "warehouse_key bigint, item_code bigint, moved double")
    store.create(months, by_month=True)
    found = {tuple(r) for r in store.read().select("month", "warehouse_key", "item_code", "moved").collect()}
    assert found == {("2024-01", 1, 7, 5.0), ("2024-01", 2, 7, 1.0), ("2024-02", 1, 7, 5.0), ("2024-02", None, 7, 4.0)}
    asked = spark.createDataFrame([(1, 7), (1, 7), (3, 7)], "warehouse_key bigint, item_code bigint")
    before = stock.moved_before(store.read(), dt.date(2024, 3, 5), asked).collect()
    assert [tuple(r) for r in before] == [(1, 7, 10.0)]
