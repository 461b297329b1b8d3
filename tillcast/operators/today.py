"""Yesterday's sales, today's forecast and the stock in hand, side by side."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.operators.rollup import dedup_first
from tillcast.operators.selection import Selection, choose, exclude_items, on_day


def _chosen(
    df: DataFrame, day: Column, branches: Selection, items: Selection, groups: Selection
) -> DataFrame:
    kept = on_day(exclude_items(df), day)
    kept = choose(choose(kept, "branch", branches), "item_name", items)
    return choose(kept, "item_group", groups)


def today_forecast(
    sales: DataFrame,
    forecast: DataFrame,
    stock: DataFrame,
    as_of: date | str | Column,
    branches: Selection,
    items: Selection,
    groups: Selection,
    keep_unsold: bool = False,
) -> DataFrame:
    """One row per item sold yesterday, with today's forecast and the branch's stock.

    ``keep_unsold`` also lists items with a forecast for today that were not sold yesterday.
    The stock of a branch is the sum over its warehouses.
    """
    today = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("date")
    sold = _chosen(
        dedup_first(
            sales.select("date", "branch", "item_group", "item_name", "qty_sold"),
            ["branch", "item_name", "date"],
            ["item_group"],
        ),
        F.date_sub(today, 1),
        branches,
        items,
        groups,
    ).select("branch", "item_name", "item_group", F.col("qty_sold").alias("previous_day_sales"))
    planned = _chosen(forecast, today, branches, items, groups).select(
        "branch",
        "item_name",
        F.col("prediction").alias("today_forecast"),
        F.col("item_group").alias("_forecast_group"),
    )
    in_hand = stock.groupBy("branch", "item_name").agg(
        F.sum("quantity_present_in_branch").alias("quantity_present_in_branch")
    )
    return (
        sold.join(planned, ["branch", "item_name"], "full" if keep_unsold else "left")
        .join(in_hand, ["branch", "item_name"], "left")
        .select(
            today.alias("date"),
            "branch",
            F.coalesce("item_group", "_forecast_group").alias("item_group"),
            "item_name",
            "previous_day_sales",
            "today_forecast",
            "quantity_present_in_branch",
        )
        .distinct()
    )
