"""The enriched sales, kept by month with the sums that the forecast asks of them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.enrich import TEMPERATURES
from tillcast.sources import schemas
from tillcast.sources.fact_store import MONTH, FactStore
from tillcast.sources.schemas import SERIES_KEY


def month_statistics(facts: DataFrame) -> DataFrame:
    """Sums of each series and month. They merge over months by sum, ``print`` by exclusive or:
    it changes with any row of the month."""
    row = F.xxhash64("date", "item_group", "qty_sold", *TEMPERATURES)
    highest, lowest = TEMPERATURES
    return facts.groupBy(MONTH, *SERIES_KEY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("qty_sold").alias("n_values"),
        F.max("date").alias("last_date"),
        F.bit_xor(row).alias("print"),
        F.sum(highest).alias("max_sum"),
        F.count(highest).alias("max_count"),
        F.sum(lowest).alias("min_sum"),
        F.count(lowest).alias("min_count"),
    )


class EnrichedStore:
    """Facts and statistics in one folder, replaced month by month, both or neither.

    New months are staged with their statistics first. A run lost before that leaves the store as it
    was; one lost later is finished by ``recover``, as putting staged months in place can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.facts = FactStore(spark, f"{self.path}/facts", schemas.ENRICHED)
        self.statistics = FactStore(spark, f"{self.path}/statistics", schemas.STATISTICS)

    def exists(self) -> bool:
        """Whether a first load was finished; its statistics are written last."""
        folder, files = self.facts.folder(f"{self.statistics.path}/_SUCCESS")
        return files.exists(folder)

    def create(self, rows: DataFrame, by_month: bool = False) -> None:
        """First load, or one anew where a first load was lost; ``by_month``: see ``FactStore``."""
        self.facts.create(rows, by_month)
        self.statistics.create(month_statistics(self.facts.read()))

    def replace_months(
        self, rows: DataFrame, entry: dict | None = None, late: DataFrame | None = None
    ) -> None:
        """Put ``rows`` in place of the months that they span. ``entry``: of a streamed batch, for the
        ledger, with its late lines; both become visible with the months."""
        staging = f"{self.path}/staging/{uuid.uuid4().hex}"
        self.facts.stage(rows, f"{staging}/facts")
        if entry is not None:
            batch = F.lit(entry["batch"]).cast("bigint").alias("batch")
            self._write(late.select("*", batch), f"{staging}/late")
            written = self.spark.createDataFrame([entry], schemas.LEDGER)
            self._write(written.coalesce(1), f"{staging}/ledger")
        found = month_statistics(self.facts.staged(f"{staging}/facts"))
        self.statistics.stage(found, f"{staging}/statistics")
        self.finish(staging)

    def finish(self, staging: str) -> None:
        self.facts.overwrite(f"{staging}/facts")
        self.statistics.overwrite(f"{staging}/statistics")
        for name, schema in (("late", schemas.LATE_LINE), ("ledger", schemas.LEDGER)):
            found, files = self.facts.folder(f"{staging}/{name}")
            if files.exists(found):
                self._write(self.spark.read.schema(schema).parquet(f"{staging}/{name}"), f"{self.path}/{name}")
        folder, files = self.facts.folder(staging)
        files.delete(folder, True)

    @staticmethod
    def _write(rows: DataFrame, path: str) -> None:
        """By batch; a batch written twice is there once."""
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(path)
        )

    def _batches(self, name: str, schema: str) -> DataFrame:
        folder, files = self.facts.folder(f"{self.path}/{name}")
        if not files.exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def ledger(self) -> DataFrame:
        """A row per streamed batch: lines, late ones, and the days of the others."""
        return self._batches("ledger", schemas.LEDGER)

    def late_lines(self) -> DataFrame:
        """Lines that came too late to be added, with their batch."""
        return self._batches("late", schemas.LATE_LINE)

    def has_batch(self, batch: int) -> bool:
        return not self.ledger().filter(F.col("batch") == batch).isEmpty()

    def recover(self) -> None:
        """Finish or remove what lost runs left. To be called before a run reads the store, which has
        one writer at a time."""
        root, files = self.facts.folder(f"{self.path}/staging")
        if not files.exists(root):
            return
        for status in files.listStatus(root):
            staging = status.getPath().toString()
            if files.exists(self.facts.folder(f"{staging}/statistics/_SUCCESS")[0]):
                self.finish(staging)
            else:
                files.delete(status.getPath(), True)

    def read(self) -> DataFrame:
        return self.facts.read().drop(MONTH)

    def means(self) -> Column:
        """Mean temperatures of all rows that have them, as a struct, from the sums."""
        highest, lowest = TEMPERATURES
        sums = F.struct(
            F.try_divide(F.sum("max_sum"), F.sum("max_count")).alias(highest),
            F.try_divide(F.sum("min_sum"), F.sum("min_count")).alias(lowest),
        )
        return self.statistics.read().select(sums).scalar()

    def series(self) -> DataFrame:
        """Per series: n_rows, n_values, last_date and print of all its rows."""
        return self.statistics.read().groupBy(*SERIES_KEY).agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_values").alias("n_values"),
            F.max("last_date").alias("last_date"),
            F.bit_xor("print").alias("print"),
        )
