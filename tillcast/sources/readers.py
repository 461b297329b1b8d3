"""Scans of the input formats: parquet, CSV, JSON dimensions and an ERP over JDBC."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.sources import schemas


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def jdbc_invoice_items(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    first_day: date,
    last_day: date,
    partitions: int,
    table: str = "`tabPOS Invoice Item`",
) -> DataFrame:
    """Invoice lines of the ERP, read by ``partitions`` tasks that split the creation time.

    The bounds only place the splits: rows outside them are read by the outer tasks.
    """
    return spark.read.jdbc(
        url,
        table,
        column="creation",
        lowerBound=first_day.isoformat(),
        upperBound=last_day.isoformat(),
        numPartitions=partitions,
        properties=properties,
    ).select("creation", "item_group", "item_name", "warehouse", "qty")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, the whole document in column ``value``."""
    return spark.read.text(path, wholetext=True)


def branch_map_from_json(documents: DataFrame) -> DataFrame:
    """``{code: branch}`` documents as (code, branch) rows."""
    pairs = F.from_json("value", schemas.BRANCH_MAP)
    return documents.select(F.explode(pairs).alias("code", "branch"))


def branch_dim_from_json(documents: DataFrame) -> DataFrame:
    """``{branch: {city, latitude, longitude}}`` documents as rows."""
    pairs = F.from_json("value", schemas.BRANCH_INFO)
    return documents.select(F.explode(pairs).alias("branch", "info")).select(
        "branch", "info.city", "info.latitude", "info.longitude"
    )


def weather_from_payload(payloads: DataFrame) -> DataFrame:
    """Weather service answers (latitude, longitude, payload) as one row per day.

    An answer without ``daily`` (an error message) yields no rows.
    """
    parsed = payloads.select(
        "latitude", "longitude", F.from_json("payload", schemas.WEATHER_PAYLOAD).alias("p")
    )
    days = F.arrays_zip(
        F.col("p.daily.time"),
        F.col("p.daily.temperature_2m_max"),
        F.col("p.daily.temperature_2m_min"),
    )
    return parsed.select("latitude", "longitude", F.inline(days)).select(
        F.expr("try_cast(time as date)").alias("date"),
        "latitude",
        "longitude",
        "temperature_2m_max",
        "temperature_2m_min",
    )
