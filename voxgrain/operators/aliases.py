"""Aliases learned from corrections: what was heard and what was meant, promoted from the third sighting on.

A store is a folder of versions, one for each micro-batch that was taken in: counts of all pairs up to and with that batch. A batch adds its counts to the newest version
before its own and replaces its own version, so a batch that comes again, after a failure or a restart, changes nothing. Versions before the last two are dropped.
Pairs are counted, not sightings, so the store grows with the vocabulary and not with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: sightings from which a pair is an alias.
PROMOTED = 3
_PAIRS = "heard string, meant string, n long, first timestamp, last timestamp"


class AliasStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _system(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        """Versions that were written to the end."""
        system, place = self._system(self.folder)
        if not system.exists(place):
            return []
        found = [s.getPath() for s in system.listStatus(place) if s.getPath().getName().startswith("version=")]
        done = [p for p in found if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _read(self, version: int | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], _PAIRS)
        return self.spark.read.schema(_PAIRS).parquet(f"{self.folder}/version={version}")

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        """Adds the sightings of a batch (heard, meant, at). Pairs without a change, or with a null or empty side, are none."""
        seen = batch.select(F.lower(F.btrim("heard")).alias("heard"), F.btrim("meant").alias("meant"), "at")
        seen = seen.filter((F.col("heard") != "") & (F.col("meant") != "") & (F.col("heard") != F.col("meant")))
        new = seen.groupBy("heard", "meant").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
        before = max((v for v in self.versions() if v < batch_id), default=None)
        merged = self._read(before).unionByName(new).groupBy("heard", "meant").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        merged.write.mode("overwrite").parquet(f"{self.folder}/version={batch_id}")
        for old in self.versions():
            if old < (before if before is not None else batch_id):
                system, place = self._system(f"{self.folder}/version={old}")
                system.delete(place, True)

    def pairs(self) -> DataFrame:
        """heard, meant, n, first, last of all pairs."""
        return self._read(max(self.versions(), default=None))

    def aliases(self, promoted: int = PROMOTED) -> DataFrame:
        """heard, meant, n: of the promoted pairs of what was heard, the one seen most often, then last, then first by spelling."""
        best = Window.partitionBy("heard").orderBy(F.desc("n"), F.desc("last"), "meant")
        rows = self.pairs().filter(F.col("n") >= promoted).withColumn("nth", F.row_number().over(best))
        return rows.filter("nth = 1").select("heard", "meant", "n")

    def candidates(self, promoted: int = PROMOTED) -> DataFrame:
        """heard, meant, n of the pairs that still wait."""
        return self.pairs().filter(F.col("n") < promoted).select("heard", "meant", "n")


def learn(sightings: DataFrame, store: AliasStore, checkpoint: str) -> None:
    """Takes in all that a stream of sightings (heard, meant, at) has, batch by batch."""
    query = sightings.writeStream.foreachBatch(lambda batch, batch_id: store.absorb(batch, batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def apply(df: DataFrame, aliases: DataFrame, word: str = "word") -> DataFrame:
    """``df`` with a word replaced by its alias; an equal join of distinct spellings, broadcast by Spark where they are few."""
    known = aliases.select(F.col("heard").alias("heard_"), F.col("meant").alias("meant_"))
    joined = df.join(known, F.lower(F.btrim(F.col(word))) == F.col("heard_"), "left")
    return joined.withColumn(word, F.coalesce("meant_", word)).drop("heard_", "meant_")
