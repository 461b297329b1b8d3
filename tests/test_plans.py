"""What the physical plans must and must not contain."""

import contextlib
import datetime as dt
import io
import os
import re

import pytest
from pyspark.sql import functions as F

from tillcast.operators import rollup, selection
from tillcast.plans.catalog import CUT, QUERIES
from tillcast.session import run_dir, shared_dir
from tillcast.sources import schemas
from tillcast.sources.driver_tables import DriverTables
from tillcast.sources.fact_store import FactStore

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def details_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_no_cross_join_no_global_window(spark, key):
    plan = plan_of(QUERIES[key](spark, FOLDER))
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not re.search(r"\], \[\]|\)\]$", line), line


def test_incremental_filter_reaches_the_scan(spark):
    plan = plan_of(rollup.incremental_rollup(DriverTables(spark, FOLDER).invoice_items(), CUT))
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_selection_reaches_the_scan_and_columns_are_pruned(spark):
    path = run_dir(spark, "test-pushdown")
    row = (dt.date(2024, 1, 1), "n", "g", "i", 1.0)
    spark.createDataFrame([row], schemas.SALES).write.parquet(path)
    sales = spark.read.schema(schemas.SALES).parquet(path)
    chosen = selection.select_rows(sales, "2024-01-01", "2024-01-31", ["n", "s"], ["g"], ["i"])
    plan = details_of(chosen.groupBy("branch").agg(F.sum("qty_sold")))
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "GreaterThanOrEqual(date" in pushed and "In(branch" in pushed
    totals = details_of(sales.groupBy("branch").agg(F.sum("qty_sold")))
    assert "ReadSchema: struct<branch:string,qty_sold:double>" in totals


def test_stored_months_are_pruned(spark):
    store = FactStore(spark, run_dir(spark, "test-prune"))
    rows = [(dt.date(2024, m, 1), "n", "g", "i", 1.0) for m in (1, 2, 3)]
    store.replace_months(spark.createDataFrame(rows, schemas.SALES))
    plan = plan_of(store.read().filter("month >= '2024-03'"))
    assert re.search(r"PartitionFilters: \[.*month", plan)


def test_map_side_sums_before_the_shuffle(spark):
    plan = plan_of(QUERIES["daily_rollup"](spark, FOLDER))
    assert "partial_sum" in plan


def test_range_and_totals_sum_before_any_join(spark):
    assert "Join" not in plan_of(QUERIES["available_range"](spark, FOLDER))
    plan = plan_of(QUERIES["branch_totals"](spark, FOLDER))
    assert plan.rindex("partial_sum(l_quantity") > plan.rindex("Join")


def test_stock_choice_lies_below_the_window(spark):
    plan = plan_of(QUERIES["stock_min_range"](spark, FOLDER))
    below = plan[plan.index("Window ["):]
    assert "LeftSemi" in below and "LessThan(l_shipdate" in below
    assert "GreaterThanOrEqual(l_shipdate" in below


def test_one_days_balance_reads_its_month_and_earlier_sums(spark):
    """Equal to the running sum over all history, with the days pushed to both scans."""
    t = DriverTables(spark, FOLDER)
    day = "1998-05-17"
    found = t.stock_ledger(until=day, since=day)
    plan = details_of(found)
    pushed = next(x for x in re.findall(r"PushedFilters: \[(.*)\]", plan) if "l_shipdate" in x)
    assert "GreaterThanOrEqual(l_shipdate,1998-05-01" in pushed
    assert "LessThan(l_shipdate,1998-05-18" in pushed
    assert re.search(r"PartitionFilters: \[.*month#\d+ < 1998-05", plan)
    whole = t.stock_ledger().filter(F.col("posting_date") == day)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    assert whole.count() > 0


def test_top_five_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top5_branches"](spark, FOLDER))


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert run_dir(spark, "x") != run_dir(spark, "x")
