"""Text sources and sinks: captions, Markdown transcripts, score tables, vocabularies, logs, filter banks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clock
from ..functions.text import WORD_PIECE_MARK, strip
from .audio import file_system

SCORES = "index int, word string, p1 double, margin double"


def caption_text(vtt: Column) -> Column:
    """The words of rolling captions: lines with word timings, without tags, joined by spaces."""
    timed = F.filter(F.split(vtt, "\n", -1), lambda line: line.contains("<c>"))
    plain = F.transform(timed, lambda line: strip(F.regexp_replace(line, "<[^>]*>", "")))
    return F.array_join(F.filter(plain, lambda line: line != ""), " ")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path).select("path", caption_text(F.col("value")).alias("text"))


def markdown_body(text: Column) -> Column:
    """A transcript without its YAML header and without its first heading; later headings stay."""
    body = F.regexp_replace(text, r"\A---[\s\S]*?\n---\n", "")
    parts = F.regexp_extract(body, r"(?dm)\A([\s\S]*?)^#.*$([\s\S]*)\z", 1), F.regexp_extract(body, r"(?dm)\A([\s\S]*?)^#.*$([\s\S]*)\z", 2)
    return F.when(body.rlike("(?dm)^#"), F.concat(*parts)).otherwise(body)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path).select("path", markdown_body(F.col("value")).alias("text"))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def transcript_markdown(source: Column, engine: Column, audio: Column, wall: Column, windows: Column, generated: Column, title: Column, body: Column) -> Column:
    """A Markdown transcript under a YAML header."""
    factor = wall / F.greatest(audio, F.lit(0.001))
    head = F.format_string(
        "---\nsource: %s\nengine: %s\naudio_secs: %.1f\ntranscribe_secs: %.1f\nrtf: %.3f\nwindows: %d\ngenerated: %s\n---\n\n# %s\n\n",
        source, engine, audio.cast("double"), wall.cast("double"), factor.cast("double"), windows, generated, title,
    )
    return F.concat(head, body, F.lit("\n"))


def write_text_files(df: DataFrame, path: str, text: str, by: str) -> None:
    """One folder of text for each value of ``by``."""
    df.select(by, text).write.mode("overwrite").partitionBy(by).option("lineSep", "").text(path)


def progress_line(done: Column, audio: Column, wall: Column) -> Column:
    return F.format_string("%s / %s  wall %s  RTF %.2f", clock(done), clock(audio), clock(wall), wall / F.greatest(done, F.lit(0.001)))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Word scores: index, word, p1, margin."""
    return spark.read.csv(path, sep="\t", header=True, schema=SCORES, quote="", escape="")


def write_scores(scores: DataFrame, path: str) -> None:
    rows = scores.select("index", "word", F.format_string("%.4f", "p1").alias("p1"), F.format_string("%.4f", "margin").alias("margin"))
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="")


def read_vocabulary(spark: SparkSession, path: str, mark_as_space: bool = True, blank: int | None = None) -> DataFrame:
    """id, piece, is_blank: lines of a piece and its id, split at the last space. The blank is ``<blk>``, or a fixed id."""
    line = F.regexp_replace("value", r"(?U)\s+\z", "")
    rows = spark.read.text(path).select(F.regexp_extract(line, r"\A(.*) \+?(\d+)\z", 1).alias("piece"), F.regexp_extract(line, r"\A(.*) \+?(\d+)\z", 2).try_cast("int").alias("id"))
    rows = rows.filter(F.col("id").isNotNull())
    is_blank = F.col("piece") == "<blk>" if blank is None else F.col("id") == blank
    piece = F.replace("piece", F.lit(WORD_PIECE_MARK), F.lit(" ")) if mark_as_space else F.col("piece")
    return rows.select("id", piece.alias("piece"), is_blank.alias("is_blank"))


def read_filters(path: str, bands: int = 128, bins: int = 257) -> np.ndarray:
    """A bank of mel filters as shipped with a model: little-endian floats, (bands, bins); its size is fixed and checked."""
    system, place = file_system(path)
    with system.open_input_file(place) as source:
        raw = np.frombuffer(source.read(), "<f4")
    if raw.size != bands * bins:
        raise ValueError(f"{path} holds {raw.size} numbers, not {bands * bins}")
    return raw.reshape(bands, bins)


def write_filters(filters: np.ndarray, path: str) -> None:
    """A bank of mel filters as ``read_filters`` takes it."""
    system, place = file_system(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as sink:
        sink.write(np.ascontiguousarray(filters, "<f4").tobytes())


def log_line(ts: Column, level: Column, phase: Column, message: Column) -> Column:
    return F.format_string("[%d] %s %s: %s", ts.cast("long"), level, phase, message)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """ts, level, phase, message of log lines; lines of another shape are left out."""
    shape = r"\A\[(\d+)\] (\S+) ([^:]*): (.*)\z"
    lines = spark.read.text(path).filter(F.col("value").rlike(shape))
    part = lambda i: F.regexp_extract("value", shape, i)
    return lines.select(part(1).cast("long").alias("ts"), part(2).alias("level"), part(3).alias("phase"), part(4).alias("message"))
