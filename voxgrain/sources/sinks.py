"""Files by name as a data source's sink: a job's files appear together, or not at all.

A task writes its files to a folder of its own below ``_pending`` and hands that folder's name to the driver. When all tasks are done, the driver moves the files of
the attempts that count into place; folders of attempts that failed, were lost or ran twice go with ``_pending``. A job that fails leaves nothing. What the
driver handles is names, as any committer of files does; contents never pass through it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .audio import file_system, wav_bytes

_PENDING = "_pending"


@dataclass
class Attempt(WriterCommitMessage):
    """A task's folder, below the job's."""

    name: str


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, name: str, suffix: str, overwrite: bool):
        self.folder, self.name, self.suffix, self.overwrite, self.job = folder, name, suffix, overwrite, uuid.uuid4().hex

    def content(self, row: Row) -> bytes:
        value = row["content"]
        return value.encode() if isinstance(value, str) else bytes(value)

    def write(self, iterator: Iterator[Row]) -> Attempt:
        system, top = file_system(self.folder)
        attempt, written = uuid.uuid4().hex, set()
        place = f"{top}/{_PENDING}/{self.job}/{attempt}"
        system.create_dir(place, recursive=True)
        for row in iterator:
            stem = str(row[self.name])
            if stem in written or any(not part or part.startswith(("_", ".")) for part in stem.split("/")):
                raise ValueError(f"{stem!r} can't name a file, or names two")
            written.add(stem)
            if "/" in stem:
                system.create_dir(f"{place}/{stem}".rpartition("/")[0], recursive=True)
            with system.open_output_stream(f"{place}/{stem}{self.suffix}") as sink:
                sink.write(self.content(row))
        return Attempt(attempt)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        system, top = file_system(self.folder)
        pending = f"{top}/{_PENDING}/{self.job}"
        moves: dict[str, str] = {}
        for attempt in filter(None, messages):
            own = f"{pending}/{attempt.name}"
            for info in system.get_file_info(fs.FileSelector(own, recursive=True, allow_not_found=True)):
                if info.type != fs.FileType.File:
                    continue
                name = info.path.removeprefix(own.lstrip("/") if not info.path.startswith("/") else own).lstrip("/")
                if name in moves:
                    self.abort(messages)
                    raise ValueError(f"two tasks wrote {name}")
                moves[name] = info.path
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(top)):
                if info.type == fs.FileType.File and info.base_name.endswith(self.suffix) and info.base_name not in moves:
                    system.delete_file(info.path)
        for folder in sorted({name.rpartition("/")[0] for name in moves} - {""}):
            system.create_dir(f"{top}/{folder}", recursive=True)
        for name, path in moves.items():
            system.move(path, f"{top}/{name}")
        self._clear(system, top)

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, system, top: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{top}/{_PENDING}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{_PENDING}/{self.job}")
        if system.get_file_info(f"{top}/{_PENDING}").type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(f"{top}/{_PENDING}")):
            system.delete_dir(f"{top}/{_PENDING}")


class WavWriter(FileWriter):
    def content(self, row: Row) -> bytes:
        return wav_bytes([] if row["samples"] is None else row["samples"], int(row["rate"]))


class NamedFiles(DataSource):
    """Rows (name, content: string or binary) as files ``<name><suffix>``; options: path, name (a column), suffix. A name may hold folders; overwriting replaces files beside each other only."""

    made_by, default_suffix = FileWriter, ""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return self.made_by(self.options["path"], self.options.get("name", "name"), self.options.get("suffix", self.default_suffix), overwrite)


class WavFiles(NamedFiles):
    """Rows (name, rate, samples) as mono WAV files of 32-bit floats."""

    made_by, default_suffix = WavWriter, ".wav"

    @classmethod
    def name(cls) -> str:
        return "wav_files"


def register(spark: SparkSession) -> None:
    for source in (NamedFiles, WavFiles):
        spark.dataSource.register(source)


def write_wav(clips: DataFrame, folder: str, name: str = "stamp", mode: str = "append") -> None:
    """``clips`` (name, rate, samples) as ``<name>.wav`` in a folder of any file system that pyarrow knows."""
    register(clips.sparkSession)
    clips.select(name, "rate", "samples").write.format("wav_files").option("name", name).mode(mode).save(folder)


def write_markdown(pages: DataFrame, folder: str, text: str, name: str = "stem", mode: str = "append") -> None:
    """``text`` of each row as ``<name>.md``."""
    register(pages.sparkSession)
    pages.select(name, pages[text].alias("content")).write.format("named_files").option("name", name).option("suffix", ".md").mode(mode).save(folder)
