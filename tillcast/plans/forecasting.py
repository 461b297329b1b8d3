"""The weekly forecast job: skipped when there is nothing new."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.forecast import forecast_forward
from tillcast.session import materialize
from tillcast.sources import schemas
from tillcast.sources.enriched_store import EnrichedStore
from tillcast.sources.fact_store import folder_of
from tillcast.sources.readers import read_parquet
from tillcast.sources.schemas import SERIES_KEY

#: Runs of which the forecast is kept; at least two, for those who read the one before.
KEPT_RUNS = 3
SERVED = "run string, at timestamp"
PRINTS = "branch string, item_name string, print bigint"


def refresh_forecast(
    spark: SparkSession,
    has_new_rows: bool,
    enriched: DataFrame,
    path: str,
    holidays: DataFrame | None = None,
    weather: DataFrame | None = None,
) -> DataFrame:
    """The stored forecast, computed anew first if the refresh of the sales brought new rows.

    Each run writes a folder of its own and then adds its name to the table of served runs, so
    a run that is lost on the way leaves the forecast before it in service.
    """
    if has_new_rows:
        run = uuid.uuid4().hex
        made = forecast_forward(enriched, holidays=holidays, weather=weather)
        made.write.parquet(f"{path}/runs/{run}")
        _serve(spark, path, run)
    return read_parquet(spark, f"{path}/runs/{_served(spark, path)}", schemas.FORECAST)


def _serve(spark: SparkSession, path: str, run: str) -> None:
    entry = spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("at"))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/served")
    retire_runs(spark, path)


def retire_runs(spark: SparkSession, path: str, keep: int = KEPT_RUNS) -> None:
    """Remove the folders of all runs but the ``keep`` served last, lost ones included.

    A reader has the forecast it was given for that many further runs. There is one writer at a time
    and it calls this after its own run is served, so no unserved folder is still being written.
    """
    served = read_parquet(spark, f"{path}/served", SERVED)
    newest = {r["run"] for r in served.orderBy(F.desc("at")).limit(keep).collect()}
    for kind in ("runs", "prints"):
        root, files = folder_of(spark, f"{path}/{kind}")
        if not files.exists(root):
            continue
        for status in files.listStatus(root):
            if status.getPath().getName() not in newest:
                files.delete(status.getPath(), True)


def _served(spark: SparkSession, path: str) -> str | None:
    """Name of the newest finished run, None before the first."""
    try:
        served = read_parquet(spark, f"{path}/served", SERVED)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return served.agg(F.max_by("run", "at")).first()[0]


def refit_changed(
    spark: SparkSession,
    store: EnrichedStore,
    path: str,
    holidays: DataFrame | None = None,
    weather: DataFrame | None = None,
) -> DataFrame:
    """The stored forecast, with those series fitted again that have new or other rows.

    Each run also keeps the print of every series; a series whose print is still the same keeps its
    forecast. What changed is known from the store's statistics, so only the rows of changed series
    are shuffled and fitted, and a refresh without any writes nothing.
    """
    prints = materialize(store.series().select(*SERIES_KEY, "print"), "series-prints")
    before = _served(spark, path)
    changed = prints
    if before is not None:
        old = read_parquet(spark, f"{path}/prints/{before}", PRINTS)
        changed = materialize(
            prints.join(old, [*SERIES_KEY, "print"], "left_anti"), "series-changed"
        )
        if changed.isEmpty() and old.count() == prints.count():
            return read_parquet(spark, f"{path}/runs/{before}", schemas.FORECAST)
    keys = changed.select(*SERIES_KEY)
    made = forecast_forward(
        store.read(),
        holidays=holidays,
        weather=weather,
        means=store.means(),
        only=lambda rows: rows.join(keys, SERIES_KEY, "left_semi"),
    )
    if before is not None:
        kept = prints.join(keys, SERIES_KEY, "left_anti").select(*SERIES_KEY)
        served = read_parquet(spark, f"{path}/runs/{before}", schemas.FORECAST)
        made = made.unionByName(served.join(kept, SERIES_KEY, "left_semi"))
    run = uuid.uuid4().hex
    made.write.parquet(f"{path}/runs/{run}")
    prints.write.parquet(f"{path}/prints/{run}")
    _serve(spark, path, run)
    return read_parquet(spark, f"{path}/runs/{run}", schemas.FORECAST)
