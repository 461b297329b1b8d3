"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.session import materialize


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it can reach.

    Large-star and small-star rounds in turn until the stars stand still: a number of rounds that
    grows with the logarithm of the longest path. All state is a table of at most
    as many links; each round is written, so a lost executor costs no earlier round.
    """
    stars = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        f"{label}-links",
    )
    before = None
    while True:
        state = stars.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(" ", "a", "b")))
        ).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = materialize(
            both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), f"{label}-low"
        )
        # every larger neighbour of a node goes to the smallest of the node and its neighbours
        large = materialize(
            both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(),
            f"{label}-large",
        )
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("low")), f"{label}-low")
        # every smaller neighbour of a node, and the node, go to the smallest of them
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = lowest.select("a", F.col("low").alias("b"))
        stars = materialize(
            small.unionByName(own).filter("a <> b").distinct(), f"{label}-small"
        )
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
