"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Documents are dealt to shards by a seeded hash, so that no source meets in one task. In each shard
a source's documents, in seeded order, form a line of words. Blocks of equal size go to the sources
of the shard by highest quotients of their targets; a quota of blocks is then a run of blocks of
the line from a seeded place on, going round. All of it is sums, ranks and joins; the length
of a run decides, so no row is made per block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.session import materialize

#: Documents of the largest source that a shard holds on average.
SHARD_ROWS = 20_000
#: The smallest cell's target holds at least so many blocks, if blocks of one word allow it.
CELL_BLOCKS = 64
MOST_BLOCK = 256


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null: 0."""
    runs = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return runs.cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...], share: float, most: float
) -> DataFrame:
    """(source, source_size) with weight and target added.

    Sources by code point, null last, take ``weights`` in turn. Targets share ``share`` of all
    sizes by weight and stop at ``most`` times the source's size; what is above goes to the
    others by weight until none is above. In the order of size by weight, the sources
    that stop come first, so running sums give the level of all others at once: that of the first
    source that stays below its stop.
    One row per source: the only step that isn't split, and one that doesn't grow with the rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*map(F.lit, weights))
    place = ((F.row_number().over(by_name) - 1) % len(weights)) + 1
    weighed = sizes.withColumn("weight", F.element_at(listed, place).cast("double"))
    cap = F.col("source_size") * F.lit(most)
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    levels = (
        weighed.withColumn("cap", cap)
        .withColumn("all", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all") - F.col("used")) / F.sum("weight").over(after))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.max(F.when(F.col("open"), F.col("level"))).over(whole)
    target = F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def block_quotas(cells: DataFrame, block: int) -> DataFrame:
    """(shard, source, wanted words) with the blocks that the cell gets, by Sainte-Lague.

    A shard has as many blocks as its wanted words make, and block j (from 0) of a cell has
    the quotient wanted / (2 j + 1); the highest win, ties by source. A cell's share rounded, less
    half the number of cells, is sure to be won, so only the quotients after it are ranked.
    """
    shard = Window.partitionBy("shard")
    n = F.col("cells")
    sure = F.round(F.col("wanted") / block) - F.ceil(n / 2) - 1
    counted = (
        cells.withColumn("cells", F.count(F.lit(1)).over(shard))
        .withColumn("seats", F.round(F.sum("wanted").over(shard) / block).cast("bigint"))
        .withColumn("sure", F.greatest(sure, F.lit(0)).cast("bigint"))
        .withColumn("open", F.col("seats") - F.sum("sure").over(shard))
    )
    offered = counted.withColumn("j", F.explode(F.sequence(F.lit(0), n.cast("int") + 3)))
    quotient = F.col("wanted") / (2 * (F.col("sure") + F.col("j")) + 1)
    best = shard.orderBy(quotient.desc(), F.col("source").asc_nulls_last(), "j")
    won = offered.withColumn("rank", F.row_number().over(best))
    taken = F.count_if((F.col("rank") <= F.col("open")) & (F.col("wanted") > 0))
    return won.groupBy("shard", "source").agg(
        F.first("sure").alias("sure"), taken.alias("more")
    ).select("shard", "source", (F.col("sure") + F.col("more")).alias("blocks"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    source: str = "source",
    text: str = "text",
    id: str = "doc_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """All rows of ``docs`` in one column ``row`` (a struct of the columns to keep, all unless
    stated), with size, source_size, target and taken (words of the document that the mix takes,
    repeats counted).

    A null text has size 0; a document of size 0 is never taken. A null source is a source of
    its own, the last. Rows with equal ids and texts may change places, nothing else may; so
    reruns agree. An empty table gives no rows. Names of columns in ``row`` don't matter.
    """
    keep = docs.columns if keep is None else keep
    sized = docs.select(
        F.struct(*(docs[c] for c in keep)).alias("row"),
        docs[source].alias("source"),
        word_count(docs[text]).alias("size"),
        F.xxhash64(F.lit(seed), docs[id], docs[text]).alias("key"),
    )
    if text in keep:  # texts are not written once more
        counted = materialize(sized.drop("row"), "mix-sizes")
    else:
        counted = sized = materialize(sized, "mix-sizes")
    totals = counted.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    totals = materialize(totals, "mix-totals")
    largest = totals.agg(F.max("rows")).first()[0] or 0
    shards = max(1, math.ceil(largest / SHARD_ROWS))
    targets = materialize(
        source_targets(totals.select("source", "source_size"), weights, share, most), "mix-targets"
    )
    shard = F.pmod(F.col("key"), F.lit(shards)).cast("int")
    dealt = sized.withColumn("shard", shard)
    held = counted.withColumn("shard", shard).groupBy("shard", "source").agg(F.sum("size").alias("words"))
    same = F.col("held.source").eqNullSafe(F.col("targets.source"))
    cells = materialize(
        held.alias("held")
        .join(targets.alias("targets"), same)
        .filter("words > 0")
        .select(
            "shard",
            "held.source",
            "words",
            (F.col("target") * F.col("words") / F.col("source_size")).alias("wanted"),
        ),
        "mix-cells",
    )
    smallest = cells.agg(F.min("wanted")).first()[0] or 0.0
    block = int(min(max(smallest // CELL_BLOCKS, 1), MOST_BLOCK))
    quotas = block_quotas(cells.select("shard", "source", "wanted"), block)
    words = F.col("words")
    asked = F.least(F.col("blocks") * block, (words * F.lit(most)).cast("bigint"))
    blocks_held = F.ceil(words / block)
    place = F.pmod(F.xxhash64(F.lit(seed), "cells.shard", "cells.source"), blocks_held) * block
    runs = materialize(
        cells.alias("cells")
        .join(
            quotas.alias("quotas"),
            (F.col("cells.shard") == F.col("quotas.shard"))
            & F.col("cells.source").eqNullSafe(F.col("quotas.source")),
        )
        .select(
            F.col("cells.shard").alias("shard"),
            F.col("cells.source").alias("source"),
            "words",
            F.floor(asked / words).alias("rounds"),
            (asked % words).alias("run"),
            place.alias("place"),
        ),
        "mix-runs",
    )
    line = Window.partitionBy("shard", "source").orderBy("key", "size")
    laid = dealt.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))

    def overlap(low: Column, high: Column) -> Column:
        start = F.col("end") - F.col("size")
        return F.greatest(F.least(F.col("end"), high) - F.greatest(start, low), F.lit(0))

    stop = F.col("place") + F.col("run")
    part = overlap(F.col("place"), stop) + overlap(F.lit(0), stop - F.col("words"))
    taken = F.coalesce(F.col("rounds") * F.col("size") + part, F.lit(0)).cast("bigint")
    return (
        laid.alias("laid")
        .join(
            runs.alias("runs"),
            (F.col("laid.shard") == F.col("runs.shard"))
            & F.col("laid.source").eqNullSafe(F.col("runs.source")),
            "left",
        )
        .select("row", "size", F.col("laid.source").alias("source"), taken.alias("taken"))
        .alias("taken_rows")
        .join(targets.alias("t"), F.col("taken_rows.source").eqNullSafe(F.col("t.source")), "left")
        .select("row", "size", "source_size", "target", "taken")
    )
