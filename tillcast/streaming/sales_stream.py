"""The sales lines as a stream: every micro-batch is added to the store of enriched sales once.

Lines get their branch name by a stream-static join. A micro-batch is summed per day and series, takes
its weather from the static table, and is added to the stored months that it touches. The store is
the only state: its ledger names every committed batch, and a batch's months, their statistics
and its ledger entry are staged together before any is put in place. A batch that is run again after
a failure is found in the ledger or finished from staging, so no line counts twice. Lines older than
the newest stored day minus the look-back are late: they are kept beside the sales and counted.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tillcast.operators.enrich import TEMPERATURES, enrich_sales
from tillcast.operators.lookup import map_branches
from tillcast.sources.enriched_store import EnrichedStore
from tillcast.sources.fact_store import MONTH, month_of
from tillcast.sources.schemas import SALES_KEY
from tillcast.streaming.daily_rollup import LOOK_BACK_DAYS


def added(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Enriched rows of both, with quantities of equal keys summed; whatever else a row holds follows
    from its branch and date, and is known in at least one of the two."""
    rest = [F.max(c).alias(c) for c in ("day", "is_weekend", *TEMPERATURES)]
    both = stored.unionByName(batch)
    return both.groupBy(*SALES_KEY).agg(F.sum("qty_sold").alias("qty_sold"), *rest)


def commit(
    lines: DataFrame,
    batch_id: int,
    branch_dim: DataFrame,
    weather: DataFrame,
    store: EnrichedStore,
    look_back: int = LOOK_BACK_DAYS,
) -> None:
    """Add a batch of lines, which carry their branch, to the store, unless that was done before."""
    store.recover()
    if store.has_batch(batch_id):
        return
    stored = store.facts.read_if_exists()
    mark = None if stored is None else store.facts.high_water_mark(stored)
    dated = lines.withColumn("date", F.to_date("creation"))
    late = F.lit(False)
    if mark is not None:
        late = F.coalesce(F.col("date") < F.lit(mark - timedelta(days=look_back)), F.lit(False))
    dated = dated.withColumn("late", late).persist()
    try:
        counts = dated.agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.count_if("late").alias("n_late"),
            F.min(F.when(~F.col("late"), F.col("date"))).alias("first_day"),
            F.max(F.when(~F.col("late"), F.col("date"))).alias("last_day"),
        ).first()
        entry = {"batch": batch_id, **counts.asDict()}
        sums = dated.filter(~F.col("late")).groupBy(*SALES_KEY).agg(F.sum("qty").alias("qty_sold"))
        days = weather
        if counts["first_day"] is not None:
            days = weather.filter(F.col("date").between(counts["first_day"], counts["last_day"]))
        merged = enrich_sales(sums, branch_dim, days)
        if stored is not None and counts["first_day"] is not None:
            months = month_of("first"), month_of("last")
            span = F.lit(counts["first_day"]).alias("first"), F.lit(counts["last_day"]).alias("last")
            first, last = store.spark.range(1).select(*span).select(*months).first()
            touched = stored.filter(F.col(MONTH).between(first, last)).drop(MONTH)
            merged = added(touched, merged)
        kept = dated.filter("late").drop("late", "date")
        store.replace_months(merged, entry, kept)
    finally:
        dated.unpersist()


def start(
    lines: DataFrame,
    branch_map: DataFrame,
    branch_dim: DataFrame,
    weather: DataFrame,
    store: EnrichedStore,
) -> StreamingQuery:
    """Run over the lines that have arrived; progress is kept in the store's folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        commit(batch, batch_id, branch_dim, weather, store)

    return (
        map_branches(lines, branch_map)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{store.path}/progress")
        .trigger(availableNow=True)
        .start()
    )
