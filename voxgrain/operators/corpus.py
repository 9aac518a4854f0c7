"""The corpus of recorded clips: entries, their labels, progress towards a goal, and benchmark reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.numeric import parse_stamp, real_time_factor, stamp
from ..functions.text import eval_tokens, unwrap_prompt
from .evaluate import match_clips, word_distance

ENTRY = StructType(
    [
        StructField("recorded", StringType()),
        StructField("mode", StringType()),
        StructField("engine", StringType()),
        StructField("device_sample_rate", IntegerType()),
        StructField("duration_secs", FloatType()),
        StructField("raw", StringType()),
        StructField("injected", StringType()),
        StructField("transcribe_secs", FloatType()),
        StructField("reference", StringType()),
    ]
)
MATCH_LOG = StructType([StructField("at", StringType()), StructField("stem", StringType()), StructField("source", StringType()), StructField("difference", DoubleType())])


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """stem and fields of the entries of a folder, one JSON file each; files that aren't JSON are left out."""
    rows = spark.read.schema(ENTRY).json(path, multiLine=True, mode="PERMISSIVE", pathGlobFilter="*.json")
    # A file that is no JSON reads as a row of nulls.
    rows = rows.filter(F.coalesce("recorded", "mode", "engine", "raw", "injected").isNotNull())
    return rows.withColumn("stem", F.regexp_extract("_metadata.file_name", r"\A(.*)\.json\z", 1))


def write_entries(entries: DataFrame, path: str) -> None:
    """Entries as a table, by day of recording."""
    entries.withColumn("day", F.substring("recorded", 1, 10)).write.mode("append").partitionBy("day").json(path)


def bank(entries: DataFrame, at: str = "at") -> DataFrame:
    """Entries keyed by their UTC stamp."""
    return entries.withColumn("recorded", stamp(F.col(at)))


def propose_labels(dictations: DataFrame, entries: DataFrame, group: str = "owner") -> DataFrame:
    """Proposed references: ``dictations`` (dictation, owner, at, source, raw) against ``entries`` (owner, stem, recorded, injected, reference)."""
    text = unwrap_prompt(F.col("raw"))
    asked = dictations.filter(F.length("raw") <= 20_000).withColumn("text", text).withColumn("words", eval_tokens(F.col("text")))
    clips = entries.select(group, "stem", parse_stamp(F.coalesce("recorded", "stem")).alias("recorded"), eval_tokens(F.coalesce("injected", F.lit(""))).alias("words"), "reference")
    return match_clips(asked, clips, group=group)


def label(entries: DataFrame, proposals: DataFrame, group: str = "owner") -> DataFrame:
    """Entries with the proposed references; a reference that is already there stays."""
    new = proposals.select(group, "stem", F.col("reference").alias("proposed_"))
    return entries.join(new, [group, "stem"], "left").withColumn("reference", F.coalesce("reference", "proposed_")).drop("proposed_")


def append_match_log(proposals: DataFrame, at: Column, path: str) -> None:
    rows = proposals.select(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"), "stem", "source", F.format_string("%.3f", "difference").alias("difference"))
    rows.write.mode("append").csv(path, sep="\t")


def progress(clips: DataFrame, goal: int = 120) -> DataFrame:
    """Whole minutes of ``clips`` (seconds) against a goal of minutes, and the line that reports them."""
    minutes = F.floor(F.coalesce(F.sum("seconds"), F.lit(0.0)) / 60)
    return clips.agg(minutes.alias("minutes")).select("minutes", F.lit(goal).alias("goal"), F.format_string("%d completed towards %d goal", F.col("minutes"), F.lit(goal)).alias("line"))


def speed_report(runs: DataFrame, *by: str, guard: bool = True) -> DataFrame:
    """Clips, seconds of audio, wall time and real-time factor of ``runs`` (audio_secs, wall_secs)."""
    sums = runs.groupBy(*by).agg(F.count("*").alias("clips"), F.sum("audio_secs").alias("audio_secs"), F.sum("wall_secs").alias("wall_secs"))
    return sums.withColumn("rtf", real_time_factor(F.col("wall_secs"), F.col("audio_secs"), guard))


def error_report(entries: DataFrame, *by: str, said: str = "raw") -> DataFrame:
    """Clips, reference words, errors and word error rate of ``entries`` (reference, ``said``) with a reference; those of a group are pooled.

    A null text is empty. A group without reference words has no rate.
    """
    rows = entries.filter(F.col("reference").isNotNull()).select(*by, eval_tokens(F.col("reference")).alias("r"), eval_tokens(F.coalesce(F.col(said), F.lit(""))).alias("h"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("clips"), F.sum(F.size("r")).alias("words"), F.sum(word_distance(F.col("r"), F.col("h"))).alias("errors"))
    return sums.withColumn("wer", F.when(F.col("words") > 0, F.col("errors") / F.col("words")))


def transcripts(windows: DataFrame, clip: str = "clip_id", separator: str = "\n\n") -> DataFrame:
    """clip, text, windows: the texts of ``windows`` (clip, window, text) in order; blank ones are left out."""
    kept = F.transform(F.sort_array(F.collect_list(F.struct("window", "text"))), lambda w: F.regexp_replace(w["text"], r"(?U)^\s+|\s+\z", ""))
    return windows.groupBy(clip).agg(F.array_join(F.filter(kept, lambda t: t != ""), separator).alias("text"), F.count("*").alias("windows"))


def newest(entries: DataFrame, n: int = 10, group: str = "owner") -> DataFrame:
    """The ``n`` newest entries of an owner by stem; take them before any filter."""
    return entries.withColumn("nth_", F.row_number().over(Window.partitionBy(group).orderBy(F.col("stem").desc()))).filter(F.col("nth_") <= n).drop("nth_")
