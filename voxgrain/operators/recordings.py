"""Recordings to transcripts: windows cut in pauses, an engine over each, the text passes, and a Markdown page for each file, as one job.

Files are read as blocks by their bytes, so a long recording is many tasks' work from the start; its energies alone meet in one place, to be cut; and each window,
a minute or so of samples, is put together where the engine runs over it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import staged
from ..sources import audio, documents, sinks
from . import blocks as B
from .signal import RATE, resample_array
from .vocabulary import fix_with_terms

#: An engine: samples at its rate to text.
Engine = Callable[[np.ndarray], str]


def window_samples(blocks: DataFrame, windows: DataFrame, size: int = 1 << 20) -> DataFrame:
    """clip_id, window, start, end, rate, samples of ``windows`` (clip_id, window, start, end) over ``blocks`` (clip_id, rate, start, samples).

    Blocks and windows meet by the stretches of ``size`` samples that they lie in, so a clip's blocks meet the windows near them and not all.
    """
    over = lambda first, end: F.explode(F.sequence(F.floor(first / size), F.floor((end - 1) / size)))
    n = F.size("samples")
    parts = blocks.filter(n > 0).select(F.col("clip_id").alias("of"), "rate", F.col("start").alias("at"), "samples", over(F.col("start"), F.col("start") + n).alias("stretch_of"))
    asked = windows.select("*", over(F.col("start"), F.col("end")).alias("stretch"))
    met = asked.join(parts, (F.col("clip_id") == F.col("of")) & (F.col("stretch") == F.col("stretch_of")))
    # A block and a window that share several stretches count in the first one.
    met = met.filter(F.col("stretch") == F.floor(F.greatest("start", "at") / size))
    low, high = F.greatest(F.col("start") - F.col("at"), F.lit(0)), F.least(F.col("end") - F.col("at"), F.size("samples"))
    piece = F.struct(F.greatest("start", "at").alias("at"), F.slice("samples", low.cast("int") + 1, (high - low).cast("int")).alias("x"))
    pieces = met.filter(high > low).groupBy("clip_id", "window", "start", "end").agg(F.first("rate").alias("rate"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    return pieces.select("clip_id", "window", "start", "end", "rate", F.flatten(F.transform("pieces", lambda p: p["x"])).alias("samples"))


def spoken(windows: DataFrame, engine: Engine, rate: int = RATE) -> DataFrame:
    """clip_id, window, end, rate, raw: what ``engine`` makes of each window at its own ``rate``; a window shorter than a tenth of a second is empty."""
    kind = windows.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for x, source in zip(b["samples"], b["rate"]):
                heard = resample_array(np.asarray(x, np.float32), int(source), rate)
                texts.append(engine(heard) if len(heard) >= rate // 10 else "")
            yield b[["clip_id", "window", "end", "rate"]].assign(raw=texts)

    return windows.mapInPandas(run, f"clip_id {kind}, window int, end long, rate int, raw string")


def transcripts(heard: DataFrame, profile: Column, terms: DataFrame | None = None) -> DataFrame:
    """clip_id, body, windows, seconds of ``heard`` (clip_id, window, end, rate, raw): each window's text by its profile and the passes, in order, blank ones left out."""
    shaped = heard.withColumn("text", T.apply_profile(F.col("raw"), profile))
    fixed = shaped.withColumn("text", T.fix_transcription(F.col("text"))) if terms is None else fix_with_terms(shaped, terms)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("window", "text"))), lambda w: w["text"])
    seconds = F.max(F.col("end") / F.greatest(F.col("rate"), F.lit(1)))
    return fixed.groupBy("clip_id").agg(T.assemble(in_order).alias("body"), F.count("*").cast("int").alias("windows"), seconds.alias("seconds"))


def transcribe(spark: SparkSession, path: str, out: str, engine: Engine, label: str, profile: str = "Raw", terms: DataFrame | None = None, windowed: bool = True, rate: int = RATE) -> DataFrame:
    """Writes ``<stem>.md`` to ``out`` for each WAV file of ``path``; returns clip_id, stem, windows, seconds, body. Without ``windowed`` a file is one window, for engines that carry state.

    The pages' wall time is that of the whole job. A file without samples has a page without text.
    """
    began = time.time()
    blocks = audio.read_wav_blocks(spark, path)
    if windowed:
        windows = B.pause_windows(blocks)
    else:
        windows = blocks.groupBy("clip_id").agg(F.max(F.col("start") + F.size("samples")).alias("end")).select("clip_id", F.lit(0).alias("window"), F.lit(0).cast("long").alias("start"), "end").filter("end > 0")
    heard = staged(spoken(window_samples(blocks, windows), engine, rate), "heard")
    done = transcripts(heard, F.lit(profile), terms)
    files = blocks.filter("start = 0").select(F.col("clip_id").alias("of"))
    stem = F.regexp_extract("of", r"([^/]*)\.[^./]*\z", 1)
    rows = files.join(done, F.col("of") == F.col("clip_id"), "left").select(
        F.col("of").alias("clip_id"), stem.alias("stem"), F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("body", F.lit("")).alias("body")
    )
    rows = staged(rows, "transcripts")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH-mm-ss'Z'")
    page = documents.transcript_markdown(F.col("clip_id"), F.lit(label), F.col("seconds"), F.lit(time.time() - began), F.col("windows"), stamp, F.col("stem"), F.col("body"))
    sinks.write_markdown(rows.withColumn("page", page), out, "page")
    return rows
