"""Queries over signals whose clips span many tasks: embeddings of a label, one behind the other, as the blocks of a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import blocks as B
from ..operators.recordings import transcribe
from ..operators.signal import htk_filters
from ..session import folder
from ..sources import documents, replay, sinks
from ..streaming import capture
from .registry import _table, query

#: Rows of a label that are numbered in one place.
_STRETCH = 1024


def in_turn(rows: DataFrame, of: str, order: str) -> DataFrame:
    """``rows`` with ``nth``, their number from 0 within ``of`` by ``order``, a whole number without repeats.

    Rows are numbered within stretches of ``order``; only the stretches' counts are added up in one place.
    """
    stretch = F.floor(F.col(order) / _STRETCH)
    counts = rows.groupBy(F.col(of).alias("of_"), stretch.alias("at_")).agg(F.count("*").alias("n_"))
    before = counts.withColumn("before_", F.sum("n_").over(Window.partitionBy("of_").orderBy("at_")) - F.col("n_")).drop("n_")
    here = F.row_number().over(Window.partitionBy(of, stretch).orderBy(order)) - 1
    numbered = rows.withColumn("here_", here).join(before, F.col(of).eqNullSafe(F.col("of_")) & (stretch == F.col("at_")))
    return numbered.withColumn("nth", F.col("before_") + F.col("here_")).drop("of_", "at_", "here_", "before_")


def clip_blocks(spark: SparkSession, sf_dir: str, clip: str = "label") -> DataFrame:
    """clip_id, start, samples."""
    rows = in_turn(_table(spark, sf_dir, "embeddings").select(F.expr(clip).alias("clip_id"), "vec_id", "embedding"), "clip_id", "vec_id")
    return rows.select("clip_id", (F.col("nth") * 64).alias("start"), F.col("embedding").alias("samples"))


def _samples_sql(clip: str = "label") -> str:
    return f"""
x as (
  select clip, nth * 64 + i as pos, embedding[i + 1] as v
  from (select {clip} as clip, embedding, row_number() over (partition by {clip} order by vec_id) - 1 as nth from embeddings), (select unnest(range(64)) as i)),
n as (select clip, count(*) as n from x group by clip)"""


#: The windowed sinc of 44,100 to 16,000 Hz: 160 phases of 100 taps; half of them are 49 by exact arithmetic, and 50 as doubles round.
_RESAMPLED_SQL = f"""
{_samples_sql()},
taps as (
  select phase, tap, tap - 49 - phase / 160.0::double as d, 2 * 0.45::double * 16000 / 44100 as cut
  from (select unnest(range(160)) as phase), (select unnest(range(100)) as tap)),
shaped as (
  select phase, tap, case when d = 0 then 1.0 else sin(pi() * cut * d) / (pi() * cut * d) end
    * case when abs(d) <= 50 then 0.42 - 0.5 * cos(pi() * (d + 50) / 50) + 0.08 * cos(2 * pi() * (d + 50) / 50) else 0 end as g from taps),
kernel as (select phase, tap, g / sum(g) over (partition by phase) as g from shaped),
outputs as (select clip, j, j * 441 // 160 as base, j * 441 % 160 as phase from (select clip, unnest(range(n * 160 // 441)) as j from n)),
y as (
  select o.clip, o.j as pos, sum(v * g)::float::double as y
  from outputs o join kernel k on k.phase = o.phase join x on x.clip = o.clip and x.pos = o.base - 49 + k.tap group by o.clip, o.j)"""


@query(f"with {_RESAMPLED_SQL} select clip as clip_id, pos, round(y, 5) as sample from y")
def resampled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of the clips at another rate."""
    found = B.resampled(clip_blocks(spark, sf_dir), 44_100)
    rows = found.select("clip_id", "start", F.posexplode("samples").alias("place", "y"))
    return rows.select("clip_id", (F.col("start") + F.col("place")).alias("pos"), F.round(F.col("y").cast("double"), 5).alias("sample"))


@query(
    f"""with {_RESAMPLED_SQL},
m as (select clip, count(*) as m from y group by clip)
select clip as clip_id, any_value(n)::int as n_in, any_value(m)::int as n_out, round(sqrt(avg(y * y) filter (pos >= least(m // 10, 2000) and pos < m - least(m // 10, 2000))), 6) as rms
from y join n using (clip) join m using (clip) group by clip"""
)
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and levels of the clips before and after."""
    blocks = clip_blocks(spark, sf_dir)
    found = B.resampled(blocks, 44_100).select("clip_id", "start", F.size("samples").alias("size"), F.posexplode("samples").alias("place", "y"))
    n_in = blocks.groupBy("clip_id").agg(F.sum(F.size("samples")).cast("int").alias("n_in"))
    n_out = found.groupBy("clip_id").agg(F.max(F.col("start") + F.col("size")).cast("int").alias("n_out"))
    skip = F.least(F.floor(F.col("n_out") / 10), F.lit(2000))
    at = F.col("start") + F.col("place")
    body = found.join(n_out, "clip_id").filter((at >= skip) & (at < F.col("n_out") - skip))
    level = body.groupBy("clip_id").agg(F.round(F.sqrt(F.avg(F.col("y").cast("double") * F.col("y").cast("double"))), 6).alias("rms"))
    return n_in.join(n_out, "clip_id").join(level, "clip_id").select("clip_id", "n_in", "n_out", "rms")


def _windows_sql(clip: str, rate: int) -> str:
    frame, target, search = rate * 20 // 1000, 60 * rate, 8 * rate
    energy = " + ".join(f"lead(v::double * v::double, {i}) over (partition by clip order by pos)" if i else "v::double * v::double" for i in range(frame))
    return f"""
with recursive {_samples_sql(clip)},
frames as (select clip, pos, {energy} as e from x),
w as (
  select clip, -1 as w, 0::bigint as start, 0::bigint as stop from n
  union all
  select w.clip, any_value(w.w) + 1, any_value(w.stop), case when any_value(n.n) - any_value(w.stop) <= {target + search} then any_value(n.n) else arg_min(f.pos, f.e) + {frame // 2} end
  from w join n on n.clip = w.clip and w.stop < n.n
  left join frames f on f.clip = w.clip and f.pos between w.stop + {target - search} and w.stop + {target + search - frame} and (f.pos - w.stop - {target - search}) % {frame} = 0
  group by w.clip)
select clip as clip_id, w as "window", start, stop as "end" from w where w >= 0"""


@query(_windows_sql("label", 50))
def quiet_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the clips at 50 Hz, whose frames are single samples."""
    return B.pause_windows(clip_blocks(spark, sf_dir).withColumn("rate", F.lit(50)))


@query(_windows_sql("label % 2", 100))
def pause_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two long clips at 100 Hz."""
    return B.pause_windows(clip_blocks(spark, sf_dir, "label % 2").withColumn("rate", F.lit(100)))


@query(f"with {_samples_sql()} select clip as clip_id, ((n // 160 + 1) // 2)::int as frames, ((n // 160 + 1) // 2 + 511) // 512 * 512 as padded, 320 as width from n where n > 256")
def mel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of the clips' features."""
    rows = B.stacked(clip_blocks(spark, sf_dir))
    return rows.groupBy("clip_id").agg(F.count_if("is_real").cast("int").alias("frames"), F.count("*").alias("padded"), F.max(F.size("features")).alias("width"))


#: ``sounds`` (clip, k, i, s), windows of 400 samples, to ``bands`` (clip, k, m, p): power under 80 triangles, by a transform of 512.
_BANDS_SQL = """waves as (select b, i, cos(2 * pi() * b * (i + 56) / 512) as c, sin(2 * pi() * b * (i + 56) / 512) as d from (select unnest(range(257)) as b), (select unnest(range(400)) as i)),
power as (select clip, k, b, sum(s * c) * sum(s * c) + sum(s * d) * sum(s * d) as p from sounds join waves using (i) group by clip, k, b),
edges as (select m, 700 * (pow(10, m * (2595 * log10(1 + 8000 / 700.0::double)) / 81 / 2595) - 1) as hz from (select unnest(range(82)) as m)),
bank as (
  select e.m, b, greatest(0, least((b * 31.25 - e.hz) / (f.hz - e.hz), (g.hz - b * 31.25) / (g.hz - f.hz)))::float::double as w
  from edges e join edges f on f.m = e.m + 1 join edges g on g.m = e.m + 2, (select unnest(range(257)) as b)),
bands as (select clip, k, m, sum(p * w) as p from power join bank using (b) group by clip, k, m)"""


@query(
    f"""with {_samples_sql()},
size as (select clip, n, (n // 160 + 1) // 2 * 2 as frames from n where n > 256),
places as (
  select clip, n, k, i, abs(k * 160 - 200 + i) as p, greatest(n, (frames - 1) * 160 + 1) - 1 as last
  from (select *, unnest(range(frames)) as k from size), (select unnest(range(400)) as i)),
sounds as (
  select q.clip, k, i, x.v * (0.5 - 0.5 * cos(2 * pi() * i / 400))::float as s
  from (select clip, k, i, case when p > last then 2 * last - p else p end as p from places) q join x on x.clip = q.clip and x.pos = q.p),
{_BANDS_SQL},
mels as (select clip, k, m, log10(greatest(p, 1e-10)) as mel from bands),
clamped as (select clip, k, m, greatest(mel, max(mel) over (partition by clip) - 8) / 4 + 1 as mel from mels),
paired as (
  select clip, k, m, mel, (coalesce(lead(mel) over c, mel) - coalesce(lag(mel) over c, mel)) / 2 as delta from clamped window c as (partition by clip, m order by k))
select clip as clip_id, k % 2 * 160 + m as place, round(sum(mel::float::double), 4) as total from paired group by all
union all select clip, k % 2 * 160 + 80 + m, round(sum(delta::float::double), 4) from paired group by all"""
)
def band_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column of the clips' features, bands and deltas of two frames, summed over the clip."""
    rows = B.stacked(clip_blocks(spark, sf_dir)).select("clip_id", F.posexplode("features").alias("place", "value"))
    return rows.groupBy("clip_id", "place").agg(F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))


# Live captures

#: When the first chunk came, in milliseconds since 1970; a stream's watermark begins there, and what is not behind it is late.
_BEGAN = 1_700_000_000_000


def _live(spark: SparkSession, sf_dir: str, name: str, step) -> DataFrame:
    """What ``step`` makes of the clips as captures, replayed from a recording that grows by its second half after the query has stopped; it goes on from its checkpoint."""
    own, place = capture.stream_session(spark), folder(spark, name)
    replay.register(own)
    rows = _table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("capture_id"), "vec_id", "embedding")
    ends = rows.groupBy(F.col("capture_id").alias("of")).agg(F.max("vec_id").alias("end"))
    chunks = in_turn(rows, "capture_id", "vec_id").join(ends, F.col("capture_id") == F.col("of")).select(
        "capture_id", F.col("nth").alias("seq"), F.timestamp_millis(F.col("vec_id") * 10 + _BEGAN).alias("at"), F.col("embedding").alias("samples"), (F.col("vec_id") == F.col("end")).alias("is_last"), "vec_id"
    )
    half = rows.agg(F.avg("vec_id")).first()[0] or 0
    for part in (F.col("vec_id") <= half, F.col("vec_id") > half):
        replay.record(chunks.filter(part), f"{place}/in")
        found = step(own.readStream.format("capture_replay").option("path", f"{place}/in").load().withWatermark("at", "1 hour"))
        query = found.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{place}/out")


@query("select label::varchar as capture_id, count(*)::bigint as chunks, count(distinct vec_id)::bigint as last, round(sum(list_sum(list_transform(embedding, lambda v: v::double))), 5) as total from embeddings group by label")
def replayed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as they come out of a replay that was stopped half way."""
    rows = _live(spark, sf_dir, "replayed", lambda stream: stream.select("capture_id", "seq", "samples"))
    total = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return rows.groupBy("capture_id").agg(F.count("*").alias("chunks"), (F.max("seq") + 1).alias("last"), F.round(F.sum(total), 5).alias("total"))


@query(f"with {_RESAMPLED_SQL} select clip::varchar as capture_id, pos, round(y, 5) as sample from y")
def live_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks resampled as they come."""
    live = _live(spark, sf_dir, "resampled", lambda stream: capture.resampled(stream, 44_100))
    return live.select("capture_id", F.col("place").alias("pos"), F.round(F.col("sample").cast("double"), 5).alias("sample"))


_LOG_MEL_SQL = f"""
{_samples_sql()},
risen as (select clip, pos, v - case when pos > 0 then 0.97::float * lag(v) over (partition by clip order by pos) else 0::float end as v from x),
places as (
  select clip, n, k, i, abs(k * 160 - 256 + i) as p, n - 1 as last
  from (select *, unnest(range(n // 160 + 1)) as k from n), (select unnest(range(400)) as i)),
sounds as (
  select q.clip, k, i, x.v * (0.5 - 0.5 * cos(2 * pi() * i / 400))::float as s
  from (select clip, k, i, case when p > last then 2 * last - p else p end as p from places) q join risen x on x.clip = q.clip and x.pos = q.p),
{_BANDS_SQL},
mels as (select clip::varchar as capture_id, k, m, ln(p + pow(2, -24))::float::double as mel from bands)"""


@query(f"with {_LOG_MEL_SQL} select capture_id, m as band, count(*)::bigint as n, round(sum(mel), 3) as total from mels group by capture_id, m")
def live_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-mel frames of chunks as they come, each band summed over the capture."""
    live = _live(spark, sf_dir, "spectra", lambda stream: capture.spectra(stream, htk_filters()))
    rows = live.select("capture_id", F.posexplode("mel").alias("band", "mel"))
    return rows.groupBy("capture_id", "band").agg(F.count("*").alias("n"), F.round(F.sum(F.col("mel").cast("double")), 3).alias("total"))


@query(f"with {_LOG_MEL_SQL} select clip_id, frame, round(sum(mel), 4) as total, arg_max(m, mel) as loudest from (select capture_id::int as clip_id, k as frame, m, mel from mels) group by clip_id, frame")
def log_mels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log-mel frame of the clips, by a bank of filters read from a file: its sum and its loudest band."""
    bank = folder(spark, "filters") + "-bank"
    documents.write_filters(htk_filters(), bank)
    rows = B.log_mels(clip_blocks(spark, sf_dir), documents.read_filters(bank, 80, 257)).select("clip_id", "frame", F.posexplode("mel").alias("band", "mel"))
    return rows.groupBy("clip_id", "frame").agg(F.round(F.sum(F.col("mel").cast("double")), 4).alias("total"), F.max_by("band", "mel").cast("long").alias("loudest"))


def _loudest(frames, chunks: int | None):
    """The band that is loudest over a chunk and its context, and which chunk it is."""
    return [1000 * (chunks or 0) + int(frames.sum(0, dtype=float).argmax())], (chunks or 0) + 1


@query(
    f"""with {_LOG_MEL_SQL},
chunks as (select capture_id, c, m, sum(mel) as mel from mels join (select unnest(range(10000)) as c) on k >= c * 8 - 2 and k < c * 8 + 8 group by capture_id, c, m),
ends as (select capture_id, max(k) // 8 as last from mels group by capture_id)
select capture_id, c as chunk, (1000 * c + arg_max(m, mel))::int as id from chunks join ends using (capture_id) where c <= last group by capture_id, c"""
)
def live_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 8 frames behind 2 of context, decoded with carried state as they come."""
    live = _live(spark, sf_dir, "decoded", lambda stream: capture.decoded(stream, htk_filters(), _loudest, 8, 2))
    return live.select("capture_id", F.col("place").alias("chunk"), "id")


# Files


@query(
    f"""select 'clip-' || clip_id as stem, count(*)::int as windows, round(max("end") / 100.0, 2)::double as seconds,
  string_agg('I heard ' || 2 * ("end" - start) || ' samples. It is done', chr(10) || chr(10) order by "window") as text
from ({_windows_sql("label % 2", 100)}) group by clip_id"""
)
def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two long recordings as files, through the whole job to pages, which are read back; the engine says how much it hears."""
    place = folder(spark, "recordings")
    blocks = clip_blocks(spark, sf_dir, "label % 2").groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("start", "samples"))).alias("parts"))
    clips = blocks.select(F.concat(F.lit("clip-"), F.col("clip_id").cast("string")).alias("stamp"), F.lit(100).alias("rate"), F.flatten(F.transform("parts", lambda p: p["samples"])).alias("samples"))
    sinks.write_wav(clips, f"{place}/in")
    done = transcribe(spark, f"{place}/in", f"{place}/out", _hearing, "test", rate=200)
    pages = documents.read_markdown(spark, f"{place}/out").select(F.regexp_extract("path", r"([^/]*)\.md\z", 1).alias("stem"), F.regexp_replace("text", r"\A\n+|\n+\z", "").alias("text"))
    return done.select("stem", "windows", F.round("seconds", 2).alias("seconds")).join(pages, "stem")


def _hearing(samples) -> str:
    return f"i heard uh {len(samples)} samples period it is done"
