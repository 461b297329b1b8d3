"""Forecast against actual sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import numeric
from tillcast.sources.schemas import SERIES_KEY

MATCH_KEY = ["date", "item_name", "branch", "item_group"]


def match(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """Forecast rows that have an actual quantity, with the absolute error."""
    sold = actual.na.drop(subset=["qty_sold"]).select(*MATCH_KEY, "qty_sold")
    predicted = forecast.na.drop(subset=["prediction"]).select(*MATCH_KEY, "prediction")
    return (
        predicted.join(sold, MATCH_KEY)
        .distinct()
        .withColumn("absolute_error", F.abs(F.col("qty_sold") - F.col("prediction")))
    )


def with_naive_error(matched: DataFrame) -> DataFrame:
    """Distance to the previous quantity of the same series; null on its first row."""
    series = Window.partitionBy(*SERIES_KEY).orderBy("date", "item_group")
    previous = F.lag("qty_sold").over(series)
    return matched.withColumn("naive_error", F.abs(F.col("qty_sold") - previous))


def mase(matched: DataFrame) -> DataFrame:
    """Mean absolute error, that of the naive forecast, and their ratio (null if naive is 0)."""
    return (
        with_naive_error(matched)
        .agg(F.avg("absolute_error").alias("mae"), F.avg("naive_error").alias("naive_mae"))
        .withColumn("mase", numeric.ratio(F.col("mae"), F.col("naive_mae")))
    )


def with_relative_error(matched: DataFrame) -> DataFrame:
    """Absolute error in percent of the quantity; null where nothing was sold."""
    percent = numeric.ratio(F.col("absolute_error"), F.col("qty_sold")) * 100
    return matched.withColumn("relative_error", percent)


def with_zscore(matched: DataFrame) -> DataFrame:
    """Absolute error in standard deviations from its mean; null when all errors are equal.

    Mean and deviation come as one scalar subquery, so no row-by-row shuffle is needed.
    """
    error = F.col("absolute_error")
    spread = matched.select(
        F.struct(F.avg(error).alias("mean"), F.stddev_samp(error).alias("sd"))
    ).scalar()
    return matched.withColumn("zscore", numeric.ratio(error - spread["mean"], spread["sd"]))


def with_bucket(scored: DataFrame) -> DataFrame:
    z = F.col("zscore")
    return scored.withColumn(
        "bucket",
        F.when(z < -1, "z < -1").when(z <= 1, "-1 <= z <= 1").when(z > 1, "z > 1"),
    )


def bucket_counts(scored: DataFrame) -> DataFrame:
    """Rows per z-score bucket; rows without a z-score are in none."""
    return (
        with_bucket(scored)
        .filter(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def bucket_rows(scored: DataFrame) -> DataFrame:
    """The rows of every bucket as the result page lists them."""
    return (
        with_bucket(scored)
        .filter(F.col("bucket").isNotNull())
        .select(
            "bucket",
            F.col("date").alias("Date"),
            F.col("item_name").alias("Item"),
            F.col("item_group").alias("Group"),
            F.col("qty_sold").alias("Quantity Sold"),
            F.col("prediction").alias("Model Prediction"),
            F.col("zscore").alias("Z-Score Error"),
            "branch",
        )
    )


def melt(matched: DataFrame) -> DataFrame:
    """Actual and predicted quantity as (Date, Metric, Value) rows for a chart."""
    wide = matched.select(
        F.col("date").alias("Date"),
        F.col("qty_sold").alias("Quantity Sold"),
        F.col("prediction").cast("double").alias("Model Prediction"),
    )
    return wide.unpivot("Date", ["Quantity Sold", "Model Prediction"], "Metric", "Value")
