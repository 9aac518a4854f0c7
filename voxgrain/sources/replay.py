"""Recorded captures replayed as a stream: a data source with offsets in recorded time.

A recording is a folder of Parquet files with rows (capture_id, seq, at_ms, samples, is_last); ``at_ms`` is when a chunk came, in milliseconds since 1970.
It may grow, but only forwards: a new file holds times behind those that were there. The stream's offset is a time and the number of files that begin up
to it, so a query that starts again from its checkpoint goes on behind the last chunk it has had, and a file that would be missed is an error.

    replay.register(spark)
    chunks = spark.readStream.format("capture_replay").option("path", folder).load()

Without ``speed``, all that is there is given at once. With ``speed`` (times real time) and ``startTime`` (milliseconds since 1970, when the replay
begins), chunks come as they came when they were recorded. Footers tell which row groups a micro-batch reads; each is a partition of its own.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .audio import file_system

CHUNK = "capture_id string, seq long, at timestamp, samples array<float>, is_last boolean"
#: Before every recorded time.
BEGINNING = -1


@dataclass
class Stretch(InputPartition):
    """A row group's chunks after ``low`` and up to ``high``."""

    path: str
    group: int
    low: int
    high: int


class CaptureReplay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_replay"

    def schema(self) -> str:
        return CHUNK

    def streamReader(self, schema) -> ReplayReader:
        speed, began = self.options.get("speed"), self.options.get("startTime")
        if speed is not None and began is None:
            raise ValueError("a replay at some speed needs a startTime, or it would begin anew whenever the query does")
        return ReplayReader(self.options["path"], None if speed is None else float(speed), None if began is None else int(began))


class ReplayReader(DataSourceStreamReader):
    def __init__(self, folder: str, speed: float | None = None, began: int | None = None):
        self.folder, self.speed, self.began = folder, speed, began
        self.known: dict[tuple[str, int], list[tuple[int, int]]] = {}  # of each file: first and last time of its row groups

    def _files(self) -> dict[str, list[tuple[int, int]]]:
        """Row groups by file; a footer is read once."""
        from pyarrow import fs
        from pyarrow import parquet as pq

        system, top = file_system(self.folder)
        out = {}
        for info in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            hidden = any(p.startswith(("_", ".")) for p in info.path[len(top) :].split("/"))
            if info.type != fs.FileType.File or hidden or not info.path.endswith(".parquet"):
                continue
            if (info.path, info.size) not in self.known:
                with system.open_input_file(info.path) as source:
                    found = pq.ParquetFile(source).metadata
                column = next(i for i in range(found.num_columns) if found.schema.column(i).path == "at_ms")
                stats = [found.row_group(g).column(column).statistics for g in range(found.num_row_groups)]
                self.known[info.path, info.size] = [(s.min, s.max) for s in stats]
            out[info.path] = self.known[info.path, info.size]
        return {path: groups for path, groups in out.items() if groups}

    @staticmethod
    def _offset(files: dict[str, list[tuple[int, int]]], at: int) -> dict:
        return {"at": at, "files": sum(min(low for low, _ in groups) <= at for groups in files.values())}

    def initialOffset(self) -> dict:
        return {"at": BEGINNING, "files": 0}

    def latestOffset(self) -> dict:
        files = self._files()
        times = [t for groups in files.values() for t in groups]
        if not times:
            return self.initialOffset()
        first, last = min(low for low, _ in times), max(high for _, high in times)
        if self.speed is not None:
            last = max(BEGINNING, min(last, first - 1 + int(self.speed * (time.time() * 1000 - self.began))))
        return self._offset(files, last)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        files = self._files()
        for offset in (start, end):
            if self._offset(files, offset["at"]) != offset:
                raise ValueError(f"files of {self.folder} hold chunks from before {offset['at']} that were not there when the stream had passed that time")
        low, high = start["at"], end["at"]
        return [Stretch(path, g, low, high) for path, groups in sorted(files.items()) for g, (first, last) in enumerate(groups) if first <= high and last > low]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyarrow import parquet as pq

        system, _ = file_system(self.folder)
        types = [("capture_id", pa.string()), ("seq", pa.int64()), ("at", pa.timestamp("us", "UTC")), ("samples", pa.list_(pa.float32())), ("is_last", pa.bool_())]
        with system.open_input_file(partition.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(4096, row_groups=[partition.group]):
                at = batch["at_ms"]
                batch = batch.filter(pc.and_(pc.greater(at, partition.low), pc.less_equal(at, partition.high)))
                columns = [pc.multiply(batch["at_ms"], 1000) if c == "at" else batch[c] for c, _ in types]
                yield pa.RecordBatch.from_arrays([c.cast(kind) for c, (_, kind) in zip(columns, types)], schema=pa.schema(types))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureReplay)


def record(chunks: DataFrame, folder: str) -> None:
    """Adds ``chunks`` (capture_id, seq, at: timestamp, samples, is_last) to a recording."""
    at: Column = F.unix_millis("at")
    rows = chunks.select("capture_id", F.col("seq").cast("long").alias("seq"), at.alias("at_ms"), F.col("samples").cast("array<float>").alias("samples"), "is_last")
    rows.write.mode("append").parquet(folder)
