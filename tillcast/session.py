"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def local_session(cores: str = "*", app: str = "tillcast", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: on a cluster
    a machine-local path would be lost with its executor, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app_id = spark.sparkContext.applicationId
    if app_id not in _LOCAL_DIRS:
        _LOCAL_DIRS[app_id] = tempfile.mkdtemp(prefix="tillcast-")
    return _LOCAL_DIRS[app_id]


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder, never used by another run."""
    return f"{shared_dir(spark)}/tillcast/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    For results that several later steps read: they are computed once, lost executors do not
    lose them, each reader scans only its columns, and Spark knows their size when it chooses
    between broadcast and shuffle joins.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
