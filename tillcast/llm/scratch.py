"""Written intermediate results that are removed as soon as nothing reads them any more."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tillcast.session import run_dir

#: Removes the shuffle files of a query as it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables in the shared folder, by name. ``drop`` is for tables that all later steps have taken
    what they need from, into tables of their own; until then they survive lost executors. What was
    shuffled to write a table is removed once it is written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self._paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self._paths[name] = run_dir(self.spark, f"{self.label}-{name}")
        with cleaned_up(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            files.delete(folder, True)
