"""Feature columns of the sales fact: calendar, location, weather, codes, null filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import calendar
from tillcast.operators.lookup import add_branch_info, map_branches_counted
from tillcast.operators.rollup import resum
from tillcast.session import materialize

TEMPERATURES = ["temperature_2m_max", "temperature_2m_min"]


def add_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "day": calendar.weekday_name(F.col("date")),
            "is_weekend": calendar.is_weekend(F.col("date")),
        }
    )


def distinct_locations(df: DataFrame) -> DataFrame:
    return df.select("latitude", "longitude").distinct()


def add_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Daily temperatures at each row's place; null where none were measured.

    Coordinates are compared as decimals of four places, not as doubles.
    """
    place = [F.col(c).cast("decimal(9,4)").alias(f"_{c}") for c in ("latitude", "longitude")]
    measured = weather.select("date", *place, *TEMPERATURES)
    keys = ["date", "_latitude", "_longitude"]
    return (
        df.drop(*TEMPERATURES)
        .select("*", *place)
        .join(measured, keys, "left")
        .drop("_latitude", "_longitude")
    )


def weather_by_branch(weather: DataFrame, branch_dim: DataFrame) -> DataFrame:
    """Daily temperatures at each branch's place, whether anything was sold or not."""
    place = [F.col(c).cast("decimal(9,4)").alias(c) for c in ("latitude", "longitude")]
    return (
        weather.select("date", *place, *TEMPERATURES)
        .join(branch_dim.select("branch", *place), ["latitude", "longitude"])
        .select("branch", "date", *TEMPERATURES)
    )


def encode_label(df: DataFrame, column: str) -> DataFrame:
    """Replace a label of few values by its 0-based place in alphabetical order."""
    labels = df.select(F.array_sort(F.collect_set(column))).scalar()
    return df.withColumn(column, (F.array_position(labels, F.col(column)) - 1).cast("int"))


def fill_mean(df: DataFrame, columns: list[str], means: Column | None = None) -> DataFrame:
    """Fill nulls with the mean of the whole column; a column without values stays null.

    The means come from one aggregate used as a scalar subquery: one row, no window. A store
    that keeps sums gives them as ``means``, a struct, without reading the rows.
    """
    if means is None:
        means = df.select(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in columns})


def forward_fill(df: DataFrame, column: str, keys: list[str], order: list[str]) -> DataFrame:
    """Take over the last known value within a series; null keys are a series like any other.

    Two steps keep hot series apart: within each month first, then the last value of the
    earlier months is carried over through a table of one row per series and month.
    """
    month = F.trunc("date", "MM").alias("_month")
    rows = df.select("*", month)
    inside = Window.partitionBy(*keys, "_month").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    known = F.last(column, ignorenulls=True)
    filled = rows.withColumn("_inside", known.over(inside))
    months = rows.groupBy(*keys, "_month").agg(
        F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy("_month").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = months.select(
        *keys, "_month", F.last("_last", ignorenulls=True).over(before).alias("_before")
    )
    same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"carried.{k}")) for k in [*keys, "_month"]]
    value = F.coalesce("rows._inside", "carried._before").alias(column)
    return filled.alias("rows").join(carried.alias("carried"), same).select(
        *(value if c == column else F.col(f"rows.{c}") for c in df.columns)
    )


def enrich_sales(sales: DataFrame, branch_dim: DataFrame, weather: DataFrame) -> DataFrame:
    """Sales with calendar and (unfilled) weather columns."""
    return (
        sales.transform(add_calendar)
        .transform(add_branch_info, branch_dim)
        .transform(add_weather, weather)
        .drop("city", "latitude", "longitude")
    )


def preprocess(
    rollup: DataFrame, branch_map: DataFrame, branch_dim: DataFrame, weather: DataFrame
) -> DataFrame:
    """Rolled-up sales by warehouse to the enriched fact.

    The joined rows are written once: the weekday codes and the temperature means each need
    a pass over one or two of their columns before the rows themselves are finished.
    """
    joined = enrich_sales(
        rollup.transform(map_branches_counted, branch_map).transform(resum), branch_dim, weather
    )
    return (
        materialize(joined, "preprocess")
        .transform(encode_label, "day")
        .transform(fill_mean, TEMPERATURES)
    )
