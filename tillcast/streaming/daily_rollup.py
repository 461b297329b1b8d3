"""Daily rollup of a stream of sales lines, kept current by idempotent micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tillcast.operators.rollup import upsert_last
from tillcast.sources.fact_store import MONTH, FactStore, month_of

LOOK_BACK_DAYS = 1


def stream_rollup(
    lines: DataFrame,
    time: str,
    keys: Sequence[str],
    amount: Column,
    look_back: int = LOOK_BACK_DAYS,
) -> DataFrame:
    """Sum per day and keys; a line older than the newest day minus ``look_back`` is late.

    The watermark stands on the start of the day and a row at the watermark counts as late,
    hence one day more than the look-back. Days past it leave the state.
    """
    # withWatermark wants a timestamp with time zone; the day comes back unchanged below
    day = F.to_date(F.col(time)).cast("timestamp")
    return (
        lines.withColumn("_day", day)
        .withWatermark("_day", f"{look_back + 1} days")
        .groupBy("_day", *keys)
        .agg(F.sum(amount).alias("qty_sold"))
        .select(F.to_date("_day").alias("date"), *keys, "qty_sold")
    )


def totals_store(spark: SparkSession, folder: str, schema: str) -> FactStore:
    """Where a stream started with ``folder`` keeps its totals (date, keys, qty_sold)."""
    return FactStore(spark, f"{folder}/totals", schema)


def upsert(totals: DataFrame, store: FactStore) -> None:
    """Put new totals in place of the stored ones of the same day and keys.

    Totals are whole sums, so doing it twice changes nothing. Only the months they span are read
    and written again; the look-back keeps these few.
    """
    store.recover()
    stored = store.read_if_exists()
    if stored is None:
        store.create(totals)
        return
    month = month_of()
    first, last = totals.select(F.min(month), F.max(month)).first()
    between = F.col(MONTH).between(F.lit(first), F.lit(last))
    touched = stored.filter(between | F.col(MONTH).isNull()).drop(MONTH)
    keys = [c for c in totals.columns if c != "qty_sold"]
    store.replace_months(upsert_last(touched, totals, keys))


def start(rollup: DataFrame, folder: str) -> StreamingQuery:
    """Merge each micro-batch's changed totals into the stored ones.

    A batch that is run again after a failure writes the same totals, so nothing is counted
    twice. State and progress are kept in the same shared folder.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rollup.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the months and the totals are read from it, the state only once
        try:
            if not batch.isEmpty():
                upsert(batch, totals_store(batch.sparkSession, folder, schema))
        finally:
            batch.unpersist()

    return (
        rollup.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )


def current_totals(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The totals as of the last batch."""
    return totals_store(spark, folder, schema).read().drop(MONTH)
