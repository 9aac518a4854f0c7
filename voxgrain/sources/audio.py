"""WAV files: their samples, and their lengths from headers alone. The sink is in ``sinks``."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLIP = "path string, rate int, channels int, samples array<float>"


def file_system(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "file:///", uri))


def chunks(content: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, length as written) of the chunks of a RIFF file; nothing for other files."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return
    at = 12
    while at + 8 <= len(content):
        name, length = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        yield name, at + 8, length
        at += 8 + length + length % 2


def _numbers(raw: bytes, kind: int, channels: int, bits: int, first_channel: bool) -> np.ndarray:
    """Mono samples of whole frames: whole numbers are scaled to -1 to 1, channels averaged, or the first one taken."""
    width = bits // 8
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if kind == 3:
        x = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = (wide.view("<i4")[:, 0] >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2.0 ** (bits - 1)
    if channels > 1:
        frames = x.reshape(-1, channels)
        x = frames[:, 0] if first_channel else frames.mean(1, dtype=np.float32)
    return x


def layout(head: bytes) -> tuple[int, int, int, int, int, int]:
    """Kind, channels, rate, bits, and where the samples begin and how many bytes they should have, by a file's beginning."""
    form = None
    for name, at, length in chunks(head):
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head, at)
            if kind == 0xFFFE and length >= 26:  # extensible: the real kind comes later
                kind = struct.unpack_from("<H", head, at + 24)[0]
            form = kind, channels, rate, bits
        elif name == b"data" and form is not None:
            return *form, at, length
    raise ValueError("not a WAV file with samples")


def parse_wav(content: bytes, first_channel: bool = False) -> tuple[int, int, np.ndarray]:
    """Rate, channels and mono samples."""
    kind, channels, rate, bits, at, length = layout(content)
    return rate, channels, _numbers(content[at : at + length], kind, channels, bits, first_channel)


def wav_bytes(samples, rate: int) -> bytes:
    """A mono WAV file of 32-bit floats."""
    data = np.asarray(samples, "<f4").tobytes()
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3, 1, rate, rate * 4, 4, 32)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + 8 + len(data), b"WAVE") + head + struct.pack("<4sI", b"data", len(data)) + data


def header_seconds(head: bytes, size: int) -> float:
    """Seconds of audio by the header, but no more than the file holds; 0 for other files. ``head`` is the file's beginning."""
    per_second = 0
    for name, at, length in chunks(head):
        if name == b"fmt " and at + 12 <= len(head):
            per_second = struct.unpack_from("<I", head, at + 8)[0]
        elif name == b"data":
            return min(length, size - at) / per_second if per_second else 0.0
    return 0.0


def read_wav(spark: SparkSession, path: str, first_channel: bool = False) -> DataFrame:
    """path, rate, channels, samples of WAV files, at their own rates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *parse_wav(bytes(c), first_channel)) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "samples"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(path).select("path", "content").mapInPandas(run, CLIP)


def read_wav_blocks(spark: SparkSession, path: str, size: int = 1 << 20, first_channel: bool = False) -> DataFrame:
    """clip_id (the path), rate, start, samples of WAV files: blocks of ``size`` samples, each read by its own bytes, so that a long file is many tasks' work.

    An empty file of samples has one empty block.
    """

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for place, n in zip(b["path"], b["length"]):
                system, at = file_system(place)
                with system.open_input_file(at) as source:
                    kind, channels, rate, bits, begin, length = layout(source.read(min(65_536, int(n))))
                wide = bits // 8 * channels
                frames = min(length, int(n) - begin) // wide
                rows += [(place, rate, first, min(size, frames - first), begin + first * wide, kind, channels, bits) for first in range(0, max(frames, 1), size)]
            yield pd.DataFrame(rows, columns=["path", "rate", "start", "n", "at", "kind", "channels", "bits"], dtype=object)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                system, place = file_system(r.path)
                with system.open_input_file(place) as source:
                    source.seek(r.at)
                    raw = source.read(r.n * (r.bits // 8) * r.channels)
                yield pd.DataFrame({"clip_id": [r.path], "rate": [r.rate], "start": [r.start], "samples": [_numbers(raw, r.kind, r.channels, r.bits, first_channel)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(path).select("path", "length")
    blocks = files.mapInPandas(plan, "path string, rate int, start long, n long, at long, kind int, channels int, bits int")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(tasks, "path", "start").mapInPandas(read, "clip_id string, rate int, start long, samples array<float>")


def wav_seconds(spark: SparkSession, path: str) -> DataFrame:
    """path, seconds of WAV files. Only names and lengths are listed; the first 64 KB of each file are read, whatever its length."""

    @F.pandas_udf("double")
    def seconds(paths: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for at, n in zip(paths, size):
            system, place = file_system(at)
            with system.open_input_file(place) as source:
                out.append(header_seconds(source.read(min(65_536, int(n))), int(n)))
        return pd.Series(out, dtype="float64")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return files.select("path", seconds("path", "length").alias("seconds"))


def live_samples(values: Column, kind: str, channels: int) -> Column:
    """Samples of a capture device: the first channel alone, 16-bit numbers over 32767."""
    first = F.filter(values, lambda _, i: i % channels == 0)
    return F.transform(first, lambda v: v.cast("float") if kind == "f32" else (v / F.lit(32767.0)).cast("float"))
