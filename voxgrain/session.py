"""Session defaults shared by the tests, the benchmark and the command line."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or on one machine a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = scratch_dir.own = getattr(scratch_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="voxgrain-")
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share."""
    return f"{scratch_dir(spark)}/voxgrain/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what several steps read is computed once, and a lost executor costs no more than its tasks."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(app: str = "voxgrain", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster the submitting side owns these settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
