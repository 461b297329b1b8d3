"""Sharding by a two-pass external shuffle.

First pass: a seeded hash scatters the records uniformly into buckets that fit in memory. Second
pass: each bucket is put in a fixed order and then into random order by a seeded Fisher-Yates
shuffle (Spark's ``shuffle`` of an array). Dealt out in turn, the records of bucket after bucket
fill the shards, whose counts so differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.session import materialize

#: Bytes of records that a bucket holds on average, less where rows are long: see ``buckets_for``.
BUCKET_BYTES = 32 << 20


def row_bytes(records: DataFrame) -> Column:
    """Bytes of a row: of its strings, of others as JSON, 8 for each plain value."""
    total = F.lit(8)
    for field in records.schema.fields:
        value = records[field.name]
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(value)
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            size = F.octet_length(F.to_json(F.struct(value)))
        else:
            size = F.lit(0)
        total = total + F.lit(8) + F.coalesce(size, F.lit(0))
    return total.cast("bigint")


def buckets_for(total: int, longest: int) -> int:
    """Number of buckets for so many bytes: a bucket holds BUCKET_BYTES on average, or, if a row
    is longer than an eighth of that, as much less, but no less than an eighth.

    Long rows that meet in a bucket then fill it beyond BUCKET_BYTES by a few of them only.
    """
    shrink = min(8.0, max(1.0, 8 * longest / BUCKET_BYTES))
    return max(1, math.ceil(total * shrink / BUCKET_BYTES))


def shard_records(
    records: DataFrame,
    shards: int = 16,
    seed: int = 11,
    bytes_each: int | None = None,
    label: str = "shards",
) -> DataFrame:
    """All rows in one column ``row`` (a struct), with shard (0 to ``shards`` - 1) and slot (place
    in the shard, without gaps from 0). Counts of shards differ by one at most.

    The number of buckets follows the sum of the rows' bytes and the longest row, both measured in
    a pass over all rows, or ``bytes_each``, the average of a row, where the caller gives that. Rows
    are scattered by hash of their number in the table, so repeated rows, null or hot keys fill no bucket beyond the others;
    the table must give its rows in the same order when read again, as stored tables do. An empty
    table gives no rows. ``row`` keeps all columns, whatever their names. The result is
    written before it is returned, so that every reader sees the same order.
    """
    if bytes_each is None:
        size = row_bytes(records)
        total, longest = records.agg(F.sum(size), F.max(size)).first()
        buckets = buckets_for(total or 0, longest or 0)
    else:
        buckets = buckets_for(records.count() * bytes_each, bytes_each)
    numbered = records.select(
        F.struct(*(records[c] for c in records.columns)).alias("row"),
        F.monotonically_increasing_id().alias("number"),
    )
    key = F.xxhash64(F.lit(seed), F.col("number"))
    scattered = (
        numbered.select(F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"), "number", "row")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "number")
    )
    held = (
        scattered.groupBy("bucket")
        .agg(F.collect_list("row").alias("rows"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("rows", seed).alias("rows"))
    )
    shuffled = materialize(
        held.select("bucket", F.posexplode("rows").alias("at", "row")), f"{label}-shuffled"
    )
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select(
        "bucket", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("before")
    )
    place = F.col("before") + F.col("at")
    return shuffled.join(materialize(before, f"{label}-before"), "bucket").select(
        "row", (place % shards).cast("int").alias("shard"), F.floor(place / shards).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its records in the order of their slots, their columns and slot."""
    columns = [F.col("row")[c].alias(c) for c in sharded.schema["row"].dataType.names]
    (
        sharded.select("shard", *columns, "slot")
        .repartition("shard")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
