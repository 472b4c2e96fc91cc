"""Session settings the library relies on, and the shared folder of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marketlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and the clock pinned to UTC. Pass a master only outside a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_private: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local session, as in tests, may go without one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _private:
        _private.append(tempfile.mkdtemp(prefix="spark-marketlens-", dir="/tmp"))
    return _private[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables and stream checkpoints of one run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder once, so that later stages read only the columns and rows they need of it."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that one task is to sort.
ROWS_PER_TASK = 100_000


def tasks_for(rows: int) -> int:
    """Partitions for a shuffle of so many rows, so that what one task holds does not grow with the table."""
    return max(1, -(-rows // ROWS_PER_TASK))
