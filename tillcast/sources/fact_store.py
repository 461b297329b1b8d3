"""The sales fact: parquet partitioned by month, replaced month by month."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.sources import schemas

MONTH = "month"


def month_of(column: str = "date"):
    return F.date_format(F.col(column), "yyyy-MM")


def folder_of(spark: SparkSession, path: str):
    """A path and its file system, as Spark's own writers see them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


class FactStore:
    """Stored sales, one folder per month.

    ``replace_months`` writes in two steps. The new content of the touched months goes to a
    staging folder first; only then does a second job move it over the stored months with
    dynamic partition overwrite. A run that dies before the second step leaves the store
    as it was, one that dies within it is finished by ``recover`` when the next one starts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = schemas.SALES):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = f"{schema}, {MONTH} string"

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read_if_exists(self) -> DataFrame | None:
        try:
            return self.read()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    @staticmethod
    def high_water_mark(stored: DataFrame) -> date | None:
        """Latest stored date, read from the newest month only."""
        newest = stored.select(F.max(MONTH)).first()[0]
        if newest is None:
            return None
        return stored.filter(F.col(MONTH) == newest).select(F.max("date")).first()[0]

    @staticmethod
    def by_month(rows: DataFrame) -> DataFrame:
        """Rows laid out for writing: a large month over several tasks, small ones together."""
        if MONTH not in rows.columns:
            rows = rows.withColumn(MONTH, month_of())
        return rows.hint("rebalance", MONTH)

    def create(self, rows: DataFrame, by_month: bool = False) -> None:
        """First load; there is nothing to protect yet, so it is written in place. ``by_month``: the
        rows have their month and lie by it already, so they aren't shuffled again."""
        laid_out = rows if by_month else self.by_month(rows)
        laid_out.write.mode("overwrite").partitionBy(MONTH).parquet(self.path)

    def replace_months(self, rows: DataFrame) -> None:
        staging = f"{self.path}_staging/{uuid.uuid4().hex}"
        self.stage(rows, staging)
        self.promote(staging)

    def stage(self, rows: DataFrame, staging: str) -> None:
        self.by_month(rows).write.partitionBy(MONTH).parquet(staging)

    def staged(self, staging: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(staging)

    def overwrite(self, staging: str) -> None:
        """Put staged months over the stored ones; doing it twice changes nothing."""
        (
            self.staged(staging)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(MONTH)
            .parquet(self.path)
        )

    def promote(self, staging: str) -> None:
        self.overwrite(staging)
        folder, files = self.folder(staging)
        files.delete(folder, True)

    def recover(self) -> None:
        """Finish what a lost run left: a staging folder written to its end is promoted, any other
        removed. To be called before a run reads the store, which has one writer at a time."""
        root, files = self.folder(f"{self.path}_staging")
        if not files.exists(root):
            return
        for status in files.listStatus(root):
            staging = status.getPath().toString()
            if files.exists(self.folder(f"{staging}/_SUCCESS")[0]):
                self.promote(staging)
            else:
                files.delete(status.getPath(), True)

    def folder(self, path: str):
        return folder_of(self.spark, path)
