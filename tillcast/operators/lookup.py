"""Branch lookups.

Dimension sides carry no broadcast hint: Spark broadcasts them when their measured size is
below its threshold and shuffles them otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_branches(df: DataFrame, branch_map: DataFrame, code: str = "warehouse") -> DataFrame:
    """Replace warehouse codes by branch names; an unknown code stays as it is."""
    names = branch_map.select(F.col("code").alias(code), F.col("branch").alias("_branch"))
    return (
        df.join(names, code, "left")
        .withColumn("branch", F.coalesce("_branch", F.col(code)))
        .drop("_branch", *([code] if code != "branch" else []))
    )


def distinct_names(branch_map: DataFrame) -> DataFrame:
    """The map with each pair of code and branch once, and how often it was there as ``copies``.

    Where a code stands in the map many times, sums and minima join this: every row met once for
    each copy would make the work grow with lines times copies."""
    return branch_map.groupBy("code", "branch").agg(F.count(F.lit(1)).alias("copies"))


def map_branches_counted(df: DataFrame, branch_map: DataFrame, code: str = "warehouse") -> DataFrame:
    """``map_branches``, but equal rows of the map give one row, and their number as ``copies``."""
    names = distinct_names(branch_map).select(
        F.col("code").alias(code), F.col("branch").alias("_branch"), F.col("copies").alias("_copies")
    )
    return (
        df.join(names, code, "left")
        .withColumns(
            {"branch": F.coalesce("_branch", F.col(code)), "copies": F.coalesce("_copies", F.lit(1))}
        )
        .drop("_branch", "_copies", *([code] if code != "branch" else []))
    )


def add_branch_info(df: DataFrame, branch_dim: DataFrame) -> DataFrame:
    """Add city, latitude and longitude; null for an unknown branch."""
    return df.join(branch_dim.select("branch", "city", "latitude", "longitude"), "branch", "left")


def codes_of_branches(branch_map: DataFrame, branches: list[str]) -> DataFrame:
    """All warehouse codes of the chosen branches, compared without case."""
    return branch_map.filter(F.lower("branch").isin([b.lower() for b in branches]))


def unknown_branches(selection: DataFrame, branch_map: DataFrame) -> DataFrame:
    """Chosen branches that no warehouse code maps to."""
    known = branch_map.select(F.lower("branch").alias("_known"))
    return selection.join(known, F.lower(selection["branch"]) == known["_known"], "left_anti")
