"""More queries: round trips through sources and sinks, settings of models and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as T
from ..operators import catalog, corpus, decode, vocabulary
from ..session import folder as new_folder
from ..sources import audio, documents, sinks
from ..streaming import capture
from .registry import _PAIRS, ORACLE_SQL, QUERIES, _clips, _table, _tokens, _tokens_sql, _turns, query


# Settings


@query(
    """select vec_id, round(len(embedding) / greatest(vec_id % 5, 1)::double, 9) as seconds, len(embedding) < (vec_id * 7 % 1300) // 10 as too_short,
  case when vec_id % 3 = 0 and vec_id % 200 > 0 then vec_id % 200 when vec_id % 4 = 0 and vec_id % 900 >= 10 then vec_id % 900 // 10 else 56 end::bigint as frames from embeddings"""
)
def clip_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of clips, which of them are too short, and chunk sizes from configurations or names."""
    i = F.col("vec_id")
    config = F.when(i % 3 == 0, F.format_string('{"encoder": {"chunk_mel_frames": %d}}', i % 200)).when(i % 3 == 1, F.lit("no json"))
    name = F.when(i % 4 == 0, F.concat(F.lit("nemotron-"), (i % 900).cast("string"), F.lit("ms-int4"))).otherwise(F.lit("nemotron"))
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(N.duration(F.size("embedding"), i % 5), 9).alias("seconds"), N.is_too_short(F.col("embedding"), i * 7 % 1300).alias("too_short"), N.chunk_frames(config, name).alias("frames")
    )


@query(
    """select n_nationkey, array_to_string(case n_nationkey % 5 when 0 then ['LeftMeta', 'LeftCtrl'] when 1 then ['LeftAlt'] when 2 then ['LeftShift'] else [] end, '+') as modifiers,
  case n_nationkey % 5 when 0 then 'Print' when 1 then 'F5' when 2 then 'x' when 3 then 'q-k' else 'c-' end as key from nation"""
)
def chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ["W-C-Print", "a-F5", " s-x ", "q-k", "c-"])), (F.col("n_nationkey") % 5 + 1).cast("int"))
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", catalog.chord(text).alias("c"))
    return rows.select("n_nationkey", F.array_join("c.modifiers", "+").alias("modifiers"), "c.key")


@query("""select '/m/' || n_regionkey || '/granite-' || n_nationkey as path from nation where n_nationkey % 3 = 0 order by n_regionkey, '/m/' || n_regionkey || '/granite-' || n_nationkey limit 1""")
def wanted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first mode whose menu name holds a word."""
    k = F.col("n_nationkey")
    name = F.concat(F.when(k % 3 == 0, "granite-").otherwise("parakeet-"), k.cast("string"))
    files = F.when(k % 3 == 0, F.array(F.lit("model.onnx"), F.lit("tokenizer.json"))).otherwise(F.array(F.lit("encoder-model.onnx"), F.lit("decoder_joint-model.onnx"), F.lit("vocab.txt")))
    path = F.concat(F.lit("/m/"), F.col("n_regionkey").cast("string"), F.lit("/"), name)
    rows = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("base_ord"), path.alias("path"), name.alias("dir"), F.explode(files).alias("file"), F.lit(False).alias("is_base"))
    return catalog.find_mode(catalog.models(rows), "GRANITE").select("path")


# Captures


@query(
    """with s as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, row_number() over (partition by user_id order by ts desc, event_id desc) = 1 as last from events)
select user_id::varchar as capture_id, coalesce(count(*) filter (event_id % 50 <> 0) = max(seq) filter (last and event_id % 50 <> 0) + 1, false) as complete
from s where event_id % 50 <> 0 group by user_id"""
)
def complete_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as chunks of a capture, some of which are missing."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(order) - 1).withColumn("is_last", F.lead("event_id").over(order).isNull())
    return capture.is_complete(rows.filter(F.col("event_id") % 50 != 0).select(F.col("user_id").cast("string").alias("capture_id"), "seq", "is_last"))


@query(
    """select vec_id, (len(embedding) + 1) // 2 as n, round(list_sum(list_transform(range(1, len(embedding) + 1, 2), lambda i: (floor(embedding[i]::double * 32767) / 32767.0)::float::double)), 5) as total
from embeddings"""
)
def live_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as interleaved 16-bit samples of two channels."""
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * 32767))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", audio.live_samples(values, "i16", 2).alias("x"))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double")), 5).alias("total"))


@query(
    """with c as (select label, sum(len(embedding))::bigint as n, sum(list_sum(list_transform(embedding, lambda x: x::double))) as total from embeddings group by label)
select label::varchar as clip, 16000 as rate, 1 as channels, n, round(total, 3) as total, round(n / 16000.0, 6) as seconds from c"""
)
def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips written as WAV files and read back, with their lengths from the headers."""
    folder = new_folder(spark, "wav")
    clips = _clips(spark, sf_dir, 16_000).select(F.col("clip_id").cast("string").alias("stamp"), "rate", "samples")
    sinks.write_wav(clips, folder)
    stem = lambda c: F.regexp_extract(c, r"([^/]*)\.wav\z", 1)
    read = audio.read_wav(spark, folder).select(stem("path").alias("clip"), "rate", "channels", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0.0), lambda s, v: s + v.cast("double")).alias("total"))
    lengths = audio.wav_seconds(spark, folder).select(stem("path").alias("clip"), F.round("seconds", 6).alias("seconds"))
    return read.withColumn("total", F.round("total", 3)).join(lengths, "clip")


@query(
    """with f as (select vec_id, k, embedding[k * 16 + 1 : k * 16 + 16] as f from embeddings, (select unnest(range(4)) as k)),
best as (select vec_id, k, list_position(f, list_max(f)) - 1 as id from f)
select vec_id, id, k as frame, row_number() over (partition by vec_id order by k, n) - 1 as pos from best, (values (0), (1)) v(n) where id > 0"""
)
def recurrent_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy decoding of each embedding as four frames, two tokens on a frame at most; the joint network gives the frame."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, 16))
    frames = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(parts).alias("frame", "features"))
    found = decode.decode_clips(frames, lambda x: decode.rnnt_greedy(x, lambda previous, state, frame: (frame, state), blank=0, most=2), "vec_id")
    return found.select("vec_id", F.col("id").cast("long").alias("id"), F.col("frame").cast("long").alias("frame"), F.col("pos").cast("long").alias("pos"))


# Files written and read back


@query(
    _tokens_sql("▁")
    + """select user_id, (row_number() over (partition by user_id order by word) - 1)::int as index, t as word, round(a::varchar::decimal(38, 28), 4)::double as p1, round(b::varchar::decimal(38, 28), 4)::double as margin
    from (select user_id, word, string_agg(replace(piece, '▁', ''), '' order by pos) as t, least(1.0, coalesce(min(p) filter (event_type <> 'error'), 1.0)) as a,
      least(1.0, coalesce(min(p - p / 2) filter (event_type <> 'error'), 1.0)) as b from w group by user_id, word) where regexp_matches(t, '[\\p{L}\\p{N}]')"""
)
def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word scores written as tables and read back; the word carries its user."""
    folder = new_folder(spark, "scores")
    scores = decode.word_margins(_tokens(spark, sf_dir, "▁"), "user_id")
    documents.write_scores(scores.withColumn("word", F.concat_ws("|", F.col("user_id").cast("string"), "word")), folder)
    word = F.split("word", r"\|", 2)
    return documents.read_scores(spark, folder).select(word[0].cast("long").alias("user_id"), "index", word[1].alias("word"), "p1", "margin")


@query("select floor(epoch(ts))::bigint as ts, event_type as level, 'phase ' || (user_id % 3) as phase, event_id || ' ' || props as message from events")
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "log")
    message = F.concat_ws(" ", F.col("event_id").cast("string"), "props")
    line = documents.log_line(F.col("ts").cast("timestamp"), F.col("event_type"), F.concat(F.lit("phase "), (F.col("user_id") % 3).cast("string")), message)
    _table(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    return documents.read_log(spark, folder)


@query(
    """select conv_id::varchar as engine, strftime(timestamp '2026-09-06 12:00:00' + to_seconds(turn * 24000), '%Y-%m-%dT%H-%M-%SZ') as recorded,
  strftime(timestamp '2026-09-06 12:00:00' + to_seconds(turn * 24000), '%Y-%m-%d') as day, text as raw from conversations"""
)
def banked_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as entries keyed by their stamp, written by day of recording and read back."""
    folder = new_folder(spark, "entries")
    rows = _turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("engine"), F.timestamp_seconds(F.lit(1788696000) + F.col("turn") * 24000).alias("at"), F.col("text").alias("raw"))
    corpus.write_entries(corpus.bank(rows).drop("at"), folder)
    found = spark.read.schema("engine string, recorded string, raw string, day string").json(folder)
    return found.select("engine", "recorded", "day", "raw")


@query(
    """select '2026-09-06T12:00:00.000Z' as at, 's' || event_id as stem, event_type as source, round((value / 100)::varchar::decimal(38, 28), 3)::double as difference from events where value is not null"""
)
def match_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "matches")
    rows = _table(spark, sf_dir, "events").filter(F.col("value").isNotNull())
    rows = rows.select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("stem"), F.col("event_type").alias("source"), (F.col("value") / 100).alias("difference"))
    corpus.append_match_log(rows, F.timestamp_seconds(F.lit(1788696000)), folder)
    return spark.read.schema(corpus.MATCH_LOG).csv(folder, sep="\t")


@query("select n_nationkey::int as id, ' ' || lower(n_name) as piece, n_nationkey = 5 as is_blank from nation")
def vocabulary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "vocabulary")
    line = F.concat(F.lit(T.WORD_PIECE_MARK), F.lower("n_name"), F.lit(" "), F.col("n_nationkey").cast("string"))
    _table(spark, sf_dir, "nation").select(line.alias("value")).write.text(folder)
    return documents.read_vocabulary(spark, folder, blank=5)


@query("select (row_number() over (order by n_nationkey) - 1)::bigint as nth, n_name as term from nation")
def term_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms one a line, between comments and blank lines, in order."""
    folder = new_folder(spark, "terms")
    lines = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "# comment\n\n").otherwise(""), F.lit("  "), "n_name", F.lit(" "))
    _table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1).select(lines.alias("value")).write.text(folder)
    terms = vocabulary.read_terms(spark, folder)
    return terms.select((F.row_number().over(Window.orderBy("line_no")) - 1).cast("long").alias("nth"), "term")


_MODELS_SQL = ORACLE_SQL["models"].replace("'/m/' || b", "'base' || b")


@query(_MODELS_SQL)
def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of the nations' directories, found by listing files; each region is a base."""
    place, k = new_folder(spark, "models"), F.col("n_nationkey")
    directory = F.concat(F.lit("base"), F.col("n_regionkey").cast("string"), F.lit("/"), F.when(k % 3 == 0, "granite-").when(k % 3 == 1, "parakeet-").otherwise("other-"), k.cast("string"))
    graph = F.when(k % 2 == 0, ".int4.onnx").otherwise(".onnx")
    names = F.when(k % 3 == 0, F.array(F.concat(F.lit("model"), graph), F.lit("tokenizer.json"))).otherwise(F.array(F.concat(F.lit("encoder-model"), graph), F.lit("decoder_joint-model.onnx"), F.lit("vocab.txt")))
    nations = _table(spark, sf_dir, "nation")
    sinks.register(spark)
    nations.select(directory.alias("dir"), F.explode(names).alias("file")).select(F.concat_ws("/", "dir", "file").alias("name"), F.lit("x").alias("content")).write.format("named_files").mode("append").save(place)
    bases = [f"{place}/base{r.n_regionkey}" for r in nations.select("n_regionkey").distinct().orderBy("n_regionkey").collect()]
    found = catalog.models(catalog.list_files(spark, bases))
    return found.select("kind", F.regexp_extract("path", r"([^/]*/[^/]*)\z", 1).alias("path"), "variant", "label", "ord")


@query(
    _PAIRS
    + """select 'engine ' || conv_id % 3 as engine, count(*)::bigint as clips, sum(n)::bigint as words, sum(distance)::bigint as errors, round(sum(distance) / sum(n), 9) as wer
from d where turn % 7 <> 6 group by 1"""
)
def engine_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates by engine over a folder of entries, one JSON file each; every turn's reference is the turn before, and every seventh has none."""
    place = new_folder(spark, "entries")
    turns = _turns(spark, sf_dir)
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("raw"))
    pairs = turns.join(after, ["conv_id", "turn"]).withColumn("stamp", N.stamp(F.timestamp_seconds(F.lit(1788696000) + F.col("turn") * 240)))
    entry = F.struct(F.col("stamp").alias("recorded"), F.concat(F.lit("engine "), (F.col("conv_id") % 3).cast("string")).alias("engine"), "raw", F.when(F.col("turn") % 7 != 6, F.col("text")).alias("reference"))
    files = pairs.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "stamp").alias("name"), F.to_json(entry).alias("content"))
    sinks.register(spark)
    files.write.format("named_files").option("suffix", ".json").mode("append").save(place)
    return corpus.error_report(corpus.read_entries(spark, place), "engine").withColumn("wer", F.round("wer", 9))


# Prompts


@query(
    r"""with d as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from conversations)
select conv_id, turn, trim(t || ' ok then') as speech, '<|im_start|>system' || chr(10) || 'Clean it.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '[Styling: plain] [Structure: ' || (turn % 3) || '] [Context: none]' || chr(10) ||
  t || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) as prompt from d"""
)
def diarised_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers of two speakers, flattened to speech; and as prompts of a normaliser."""
    said = F.concat(F.lit("Speaker 0: "), "text", F.lit(" <|box_start|> speaker 12 : ok<|object_ref_end|>  then"))
    text = F.btrim(F.regexp_replace("text", r"\s+", " "))
    prompt = T.normaliser_prompt(text, "Clean it.", F.lit("plain"), (F.col("turn") % 3).cast("string"), F.lit("none"))
    return _turns(spark, sf_dir).select("conv_id", "turn", T.flatten_diarised(said).alias("speech"), prompt.alias("prompt"))


__all__ = ["QUERIES"]
