"""Filters behind the report pages: ranges, chosen values, exclusions and facets."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Items left out of training and of today's view (trailing blanks included).
EXCLUDED_ITEMS = [
    "Chocolate Dreamcake ",
    "Milk Chocolate",
    "Nutella",
    "Chunky Blend",
    "Apple Cup Pie",
    "White Chocolate ",
    "Carrot and Cheese (Cup Cakes)",
    "All Chocolate Dreamcake -2.5 LBS",
    "Chocolate Chunk Cookie",
    "Mango Cheese Cake",
    "Blueberry Muffin",
    "Strawberry Donut",
    "Kit Kat Donut",
    "Cotton Candy Donut",
    "Matcha (Cup Cakes)",
    "Peanut Butter (Cup Cakes)",
    "Matilda Brownie",
    "Carrot Nut 2.5 LBS",
    "Malteser 2.5 LBS",
    "Nut Fusion 2.5 LBS",
    "KitKat 2.5 LBS (Cup Cakes)",
    "KitKat 2.5 LBS",
]

# Branches left out of training.
EXCLUDED_BRANCHES = ["hayatabad", "Victoria Saddar", "Canal Road", "Peshawar Cantt"]

# Days left out of training.
EXCLUDED_DATES = [
    "2023-11-09", "2023-12-24", "2023-12-25", "2023-12-26", "2023-12-31",
    "2024-01-01", "2024-02-08", "2024-02-14", "2024-02-26", "2024-03-23",
    "2024-04-09", "2024-04-10", "2024-04-11", "2024-04-12", "2024-04-13",
    "2024-05-01", "2024-05-11", "2024-05-12", "2024-06-17", "2024-06-18",
    "2024-06-19", "2024-07-16", "2024-07-17",
]

Selection = Sequence[str] | DataFrame | None


def choose(df: DataFrame, column: str, selection: Selection) -> DataFrame:
    """Keep the chosen values: None keeps all, an empty list none, a table by semi join."""
    if selection is None:
        return df
    if isinstance(selection, DataFrame):
        return df.join(selection.select(column), column, "left_semi")
    return df.filter(F.col(column).isin(list(selection)))


def in_range(df: DataFrame, start: date | str, end: date | str, column: str = "date") -> DataFrame:
    """Closed date range."""
    return df.filter(
        F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )


def on_day(df: DataFrame, day: date | str | Column, column: str = "date") -> DataFrame:
    value = day if isinstance(day, Column) else F.lit(day)
    return df.filter(F.col(column) == value.cast("date"))


def select_rows(
    df: DataFrame,
    start: date | str,
    end: date | str,
    branches: Selection,
    groups: Selection,
    items: Selection,
) -> DataFrame:
    """Closed date range and chosen branches, groups and items."""
    kept = in_range(df, start, end)
    kept = choose(kept, "branch", branches)
    kept = choose(kept, "item_group", groups)
    return choose(kept, "item_name", items)


def sales_history(
    sales: DataFrame,
    branches: Sequence[str],
    groups: Sequence[str],
    items: Sequence[str],
    start: date | str | None = None,
    end: date | str | None = None,
    day: date | str | None = None,
) -> DataFrame:
    """Sales of a range or of one day; branches, groups and items must all be chosen."""
    if day is not None:
        start = end = day
    if start is None or end is None:
        raise ValueError("give a day, or both ends of a range")
    return select_rows(sales, start, end, branches, groups, items).select(
        F.col("date").alias("Date"),
        F.col("item_name").alias("Item"),
        F.col("item_group").alias("Group"),
        F.col("qty_sold").alias("Quantity Sold"),
        "branch",
    )


def weekly_forecast_view(
    forecast: DataFrame,
    groups: Sequence[str],
    branches: Sequence[str] = (),
    items: Sequence[str] = (),
) -> DataFrame:
    """Forecast rows of the chosen groups; no branch or no item chosen means all of them."""
    kept = choose(forecast, "branch", branches or None)
    kept = choose(kept, "item_group", groups)
    kept = choose(kept, "item_name", items or None)
    return kept.select(
        F.col("date").alias("Date"),
        F.col("item_name").alias("Item"),
        F.col("item_group").alias("Group"),
        F.col("prediction").alias("Model Prediction"),
        "branch",
    )


def branch_sales(sales: DataFrame, branch: str, groups: Sequence[str] = ()) -> DataFrame:
    """Sales of one branch, of all its groups unless some are chosen."""
    return choose(sales.filter(F.col("branch") == branch), "item_group", groups or None)


def exclude(df: DataFrame, column: str, values: Sequence[str] | DataFrame) -> DataFrame:
    """Drop rows whose value is listed; rows with null stay."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column), column, "left_anti")
    listed = F.col(column).isin(list(values))
    return df.filter(F.coalesce(~listed, F.lit(True)))


def exclude_items(
    df: DataFrame, items: Sequence[str] = EXCLUDED_ITEMS, trimmed: bool = False
) -> DataFrame:
    """Drop the excluded items, compared exactly or, with ``trimmed``, without outer blanks."""
    if not trimmed:
        return exclude(df, "item_name", items)
    listed = F.trim("item_name").isin([i.strip() for i in items])
    return df.filter(F.coalesce(~listed, F.lit(True)))


def exclude_branches(df: DataFrame, branches: Sequence[str] = EXCLUDED_BRANCHES) -> DataFrame:
    """Drop the excluded branches, compared without case."""
    listed = F.lower("branch").isin([b.lower() for b in branches])
    return df.filter(F.coalesce(~listed, F.lit(True)))


def exclude_dates(df: DataFrame, dates: Sequence[str] = EXCLUDED_DATES) -> DataFrame:
    listed = F.col("date").isin([date.fromisoformat(d) for d in dates])
    return df.filter(F.coalesce(~listed, F.lit(True)))


def facet(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Values to choose from, within the chosen groups if there are any."""
    return choose(df, "item_group", groups or None).select(column).distinct()


def available_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))
