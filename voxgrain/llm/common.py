"""What several operators share: reading tables, the shared scratch folder, and staged intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_dir

#: Words are runs of anything but these six characters: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of ``names`` that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    tail = "_"
    while any(c.startswith(f"{n}{tail}".lower()) for n in names for c in taken):
        tail += "_"
    return [n + tail for n in names]


class Stage:
    """Written intermediate tables of one query run.

    A staged table cuts the lineage: what follows rereads files that survive a lost executor
    instead of repeating the scan, tokenising or Python work that made them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/voxgrain/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, codec: str = "zstd", row_group: int | None = None) -> DataFrame:
        """``row_group`` bounds the bytes that a writer gathers and a reader unpacks at once; rows that are large themselves need it."""
        path = f"{self.root}/{name}"
        rows = df.write.option("compression", codec)
        (rows if row_group is None else rows.option("parquet.block.size", row_group).option("parquet.page.size.row.check.min", 1)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Frees a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
