"""Sales totals and rankings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions import calendar
from tillcast.operators.selection import on_day


def branch_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy("branch").agg(F.sum("qty_sold").alias("qty_sold"))


def branch_count(sales: DataFrame) -> DataFrame:
    return sales.agg(F.countDistinct("branch").alias("branches"))


def ranked(df: DataFrame, names: Sequence[str], n: int = 5, top: bool = True) -> DataFrame:
    """The n rows with most (or least) quantity; ties go by name."""
    amount = F.col("qty_sold")
    return df.orderBy(amount.desc() if top else amount.asc(), *names).limit(n)


def group_summary(sales: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Quantity and number of items of each chosen group; 0 and 0 for one without rows."""
    chosen = sales.sparkSession.createDataFrame([(g,) for g in groups], "item_group string")
    sums = (
        sales.filter(F.col("item_group").isin(list(groups)))
        .groupBy("item_group")
        .agg(
            F.sum("qty_sold").alias("qty_sold"),
            F.count_distinct("item_name").alias("unique_items"),
        )
    )
    return chosen.join(sums, "item_group", "left").na.fill(
        {"qty_sold": 0.0, "unique_items": 0}
    )


def item_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy("item_name").agg(F.sum("qty_sold").alias("qty_sold"))


def chart_by_item(sales: DataFrame) -> DataFrame:
    """Data of the stacked bars: quantity per item and group."""
    return sales.groupBy("item_name", "item_group").agg(F.sum("qty_sold").alias("qty_sold"))


def _within(sales: DataFrame, bounds: tuple[Column, Column]) -> DataFrame:
    first, last = bounds
    return sales.filter(F.col("date").between(first, last))


def daily_ranking(sales: DataFrame, day: date | str, n: int = 5, top: bool = True) -> DataFrame:
    """Rows (not totals) of one day with most or least quantity."""
    rows = on_day(sales, day).select("item_name", "item_group", "qty_sold")
    return ranked(rows, ["item_name", "item_group"], n, top)


def weekly_ranking(sales: DataFrame, day: date | str, n: int = 5, top: bool = True) -> DataFrame:
    """Items with most or least quantity in the Monday-to-Sunday week of a day."""
    week = calendar.week_bounds(F.lit(day).cast("date"))
    return ranked(item_totals(_within(sales, week)), ["item_name"], n, top)


def monthly_ranking(sales: DataFrame, day: date | str, n: int = 5, top: bool = True) -> DataFrame:
    """Items with most or least quantity in the calendar month of a day."""
    month = calendar.month_bounds(F.lit(day).cast("date"))
    return ranked(item_totals(_within(sales, month)), ["item_name"], n, top)
