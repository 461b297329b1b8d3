"""Daily rollups and duplicate handling of the sales fact.

Everything here is a grouped aggregate, so each task sums its own rows before the shuffle
and a branch or item that holds most of the lines still sends one row per task and key.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.operators.lookup import map_branches_counted
from tillcast.sources.schemas import SALES_KEY


def daily_rollup(invoice_items: DataFrame) -> DataFrame:
    """Quantity per day, item group, item and warehouse."""
    return invoice_items.groupBy(
        F.to_date("creation").alias("date"), "item_group", "item_name", "warehouse"
    ).agg(F.sum("qty").alias("qty_sold"))


def since_mark(invoice_items: DataFrame, mark: date, look_back_days: int = 1) -> DataFrame:
    """Lines from ``look_back_days`` before the mark on.

    The bare column is compared with a literal, so the filter reaches the scan.
    """
    first = mark - timedelta(days=look_back_days)
    return invoice_items.filter(F.col("creation") >= F.lit(first).cast("timestamp_ntz"))


def incremental_rollup(invoice_items: DataFrame, mark: date) -> DataFrame:
    return daily_rollup(since_mark(invoice_items, mark))


def resum(sales: DataFrame) -> DataFrame:
    """One row per sales key, after several warehouse codes took the same branch name; a row counts
    as often as its ``copies`` say, if it has them."""
    sold = F.col("qty_sold") * F.col("copies") if "copies" in sales.columns else F.col("qty_sold")
    return sales.groupBy(*SALES_KEY).agg(F.sum(sold).alias("qty_sold"))


def sales_daily(invoice_items: DataFrame, branch_map: DataFrame) -> DataFrame:
    """The sales fact from invoice lines: name the branch first, then sum once.

    A line counts once for each row that the map has for its code."""
    named = map_branches_counted(invoice_items, branch_map)
    return named.groupBy(
        F.to_date("creation").alias("date"), "branch", "item_group", "item_name"
    ).agg(F.sum(F.col("qty") * F.col("copies")).alias("qty_sold"))


def with_daily_total(sales: DataFrame) -> DataFrame:
    """Put the total of branch, item and day in place of each row's quantity.

    Its input is rolled up: a window holds the codes and groups of one item on one day.
    """
    day = Window.partitionBy("branch", "item_name", "date")
    return sales.withColumn("qty_sold", F.sum("qty_sold").over(day)).distinct()


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys the first in ``order``; an aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*").select(df.columns)


def upsert_last(stored: DataFrame, batch: DataFrame, keys: list[str] = SALES_KEY) -> DataFrame:
    """Union of stored and new rows where the new row wins; both sides unique in ``keys``."""
    both = stored.withColumn("_seq", F.lit(0)).unionByName(
        batch.withColumn("_seq", F.lit(1)), allowMissingColumns=True
    )
    rest = [c for c in both.columns if c not in keys and c != "_seq"]
    last = F.max_by(F.struct(*rest), F.col("_seq"))
    return both.groupBy(*keys).agg(last.alias("_row")).select(*keys, "_row.*")
