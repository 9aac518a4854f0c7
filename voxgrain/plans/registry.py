"""Queries over the driver's tables, by name, and the SQL that must give the same rows.

The tables stand in for speech: conversation turns are transcripts, embeddings are logits or short signals, events are
frames, tokens or key presses of a user. Each query runs over the whole of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as T
from ..operators import catalog, corpus, decode, evaluate, signal, vocabulary
from ..sources import documents

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt to all of them: what follows costs far more than a shuffle."""
    few = scan._jdf.queryExecution().toRdd().getNumPartitions() < scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(_tasks(scan.sparkSession)) if few else scan


def _pass(function, name: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _spread(_turns(spark, sf_dir)).select("conv_id", "turn", function(F.col("text")).alias("text"))

    run.__name__ = name
    query(sql)(run)


# Transcript repair. RE2 has neither backreferences nor look-around: the SQL twins use marks instead, and repetitions have none; tests hold these against models.

_W = r"\p{L}\p{M}\p{N}\p{Pc}"
_S = r"[\s\x0b\x{85}\p{Z}]"


def _correction_sql() -> str:
    expression = "text"
    for phrase in T.CORRECTIONS:
        pattern = phrase.replace(r"\w", f"[{_W}]").replace(r"\s", _S)
        expression = f"regexp_replace({expression}, '(?i)^(?:[^\\n]*[^{_W}\\n])?{pattern}{_S}+', '')"
    return f"regexp_replace(regexp_replace({expression}, '^{_S}+', ''), '{_S}+$', '')"


def _replaced(expression: str, pattern: str, new: str) -> str:
    pattern, new = pattern.replace("'", "''"), new.replace("'", "''")
    return f"regexp_replace({expression}, '{pattern}', '{new}', 'g')"


def _turns_sql(expression: str) -> str:
    return f"select conv_id, turn, {expression} as text from conversations"


def _stripped_sql(expression: str) -> str:
    return _replaced(_replaced(_replaced(expression, f"{_S}{{2,}}", " "), f"^{_S}+", ""), f"{_S}+$", "")


def _fillers_sql() -> str:
    expression, edge = "text", f"(^|[^{_W}])"
    for word in T.HESITATIONS + T.FILLERS:
        for _ in range(3):  # neighbours share what lies between them
            expression = _replaced(expression, rf"(?i){edge}{word}(?:{_S}+,?{_S}*|,{_S}*|$|([^{_W}]))", r"\1 \2")
    for pattern, new in ((rf"(?i),{_S}*like{_S}*,", ","), (rf"(?i){edge}like{_S}*,{_S}*(uh|um|so|you know)", r"\1"), (rf"(?i)^like{_S}+", "")):
        expression = _replaced(expression, pattern, new)
    return _stripped_sql(expression)


def _spoken_sql() -> str:
    """Phrases between white space become marks, with white space doubled so that neighbours can share none; then marks attach."""
    expression, mark, spaced = "text", "\x01", "\x03"
    for phrase, symbol in T.SPOKEN:
        space = "[ \t\n\f\r]"
        doubled = _replaced(expression, f"({space})", r"\1\1")
        doubled = _replaced(doubled, rf"(?i)(^|{space}){phrase.replace(' ', '  ')}({space}|$)", rf"\1{mark}\2")
        for c in " \t\n\f\r":
            doubled = f"replace({doubled}, '{c}{c}', '{c}')"
        if symbol.endswith("\n"):
            expression = _replaced(doubled, f" ?{mark} ?", symbol)
        elif symbol != symbol.strip():
            expression = f"replace(replace({_replaced(doubled, f' ?{mark}', f' {symbol.strip()}{spaced}')}, '{spaced} ', ' '), '{spaced}', ' ')"
        else:
            expression = f"replace({doubled}, '{mark} ', '{spaced} ')"
            for pattern, new in ((rf" ?(?:{mark}|{spaced} )$", symbol), (f" ?{spaced}", symbol), (f" ?{mark}", f"{symbol} ")):
                expression = _replaced(expression, pattern, new)
    return expression


def _capitals_sql(source: str = "text") -> str:
    gap = r"""[\s\x0b\x{85}\p{Z}"'(\[{“‘]*"""
    marked = _replaced(source, rf"(^{gap}|[?!\n]{gap}|\.{_S}{gap})(\p{{L}})", "\\1\x01\\2")
    joined = f"array_to_string(list_transform(string_split({marked}, '\x01'), lambda p: upper(p[1]) || p[2:]), '')"
    for _ in range(2):  # neighbours share what lies between them
        joined = _replaced(joined, f"(^|[^{_W}])i([^{_W}]|$)", r"\1I\2")
    return joined


def _contractions_sql() -> str:
    expression, edge = "text", r"[^\p{L}\p{M}\p{N}']"
    for phrase, short in T.CONTRACTIONS:
        for lead, out in ((phrase[0].upper(), short[0].upper() + short[1:]), (phrase[0].lower(), short)):
            for _ in range(2):
                expression = _replaced(expression, f"(^|{edge}){lead}(?i:{phrase[1:]})({edge}|$)", rf"\1{out}\2")
    return expression


def _repetitions_sql(source: str, name: str) -> str:
    """CTEs that end with ``name`` (conv_id, turn, text and the source's other columns): runs of three words, two and one that come again are taken out one by one.

    A text is a list of words and what lies between them in turn; a run of n words from place i on comes again if its 2 n - 1 parts are those from i + 2 n on.
    """
    part = lambda first, last: f"lower(array_to_string(p[{first}:{last}], ''))"
    again = f"{part('i', 'i + 2 * n - 2')} = {part('i + 2 * n', 'i + 4 * n - 2')} and i + 4 * n - 2 <= len(p) and regexp_full_match(p[i + 2 * n - 1], '{_S}+')"
    again += f" and regexp_full_match(array_to_string(p[i:i + 2 * n - 2], ''), '[{_W}]+({_S}+[{_W}]+)*')"
    return f"""
{name}_runs as (
  select *, 3 as n, regexp_extract_all(text, '[{_W}]+|[^{_W}]+') as p from {source}
  union all
  select * exclude (n, p, hit), case when hit is null then n - 1 else n end, case when hit is null then p else p[1:hit + 2 * n - 2] || p[hit + 4 * n - 1:] end
  from (select *, list_min(list_filter(range(1, len(p) + 1), lambda i: {again})) as hit from {name}_runs where n > 0)),
{name} as (select * exclude (n, p) replace ({_stripped_sql("array_to_string(p, '')")} as text) from {name}_runs where n = 0)"""


_pass(T.course_correction, "course_correction", _turns_sql(_correction_sql()))
_pass(T.clean_repetitions, "clean_repetitions", f"with recursive {_repetitions_sql('conversations', 'cleaned')} select conv_id, turn, text from cleaned")
_pass(T.remove_fillers, "remove_fillers", _turns_sql(_fillers_sql()))
_pass(T.spoken_punctuation, "spoken_punctuation", _turns_sql(_spoken_sql()))
_pass(T.capitalize, "capitalize", _turns_sql(_capitals_sql()))
_pass(T.restore_contractions, "restore_contractions", _turns_sql(_contractions_sql()))


@query(
    f"""with recursive shaped as (select conv_id, turn, role, text as raw, case when role = 'assistant' then {_contractions_sql()} else text end as text from conversations),
corrected as (select * replace ({_correction_sql()} as text) from shaped),{_repetitions_sql("corrected", "cleaned")},
filled as (select * replace ({_fillers_sql()} as text) from cleaned),
spoken as (select * replace ({_spoken_sql()} as text) from filled),
fixed as (select * replace ({_capitals_sql()} as text) from spoken)
select conv_id, turn, role, text as fixed, text <> raw as changed from fixed"""
)
def fix_transcription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn repaired, with whether that changed it; assistants' turns as the long profile."""
    turns = _spread(_table(spark, sf_dir, "conversations"))
    shaped = T.apply_profile(F.col("text"), F.when(F.col("role") == "assistant", "Long").otherwise("Raw"))
    fixed = turns.select("conv_id", "turn", "role", "text", T.fix_transcription(shaped).alias("fixed"))
    return fixed.select("conv_id", "turn", "role", "fixed", (F.col("fixed") != F.col("text")).alias("changed"))


@query()
def correct_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with vocabulary terms put right; the terms are the words of the nations' names."""
    names = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("line_no"), F.initcap(F.lower("n_name")).alias("term"))
    return vocabulary.correct_terms(_turns(spark, sf_dir), names)


_EVAL = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '[’'']', '''', 'g'), '[^a-z0-9'' ]+', ' ', 'g'), ' +'), lambda w: w <> '')"


@query(f"select doc_id, len({_EVAL})::bigint as n_words, array_to_string({_EVAL}, ' ') as words from documents")
def eval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", T.eval_tokens(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("words"))


@query(
    f"""select role, count(*)::bigint as turns, sum(len({_EVAL}))::bigint as words, max(len({_EVAL}))::bigint as longest,
    count(*) filter (regexp_matches(text, '[^\\x00-\\x7f]'))::bigint as beyond_ascii from conversations group by role"""
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").withColumn("n", F.size(T.eval_tokens(F.col("text"))))
    return turns.groupBy("role").agg(
        F.count("*").alias("turns"), F.sum("n").alias("words"), F.max("n").cast("long").alias("longest"), F.count_if(F.col("text").rlike(r"[^\x00-\x7f]")).alias("beyond_ascii")
    )


_PAIRS = f"""
with t as (select conv_id, turn, {_EVAL} as w from conversations),
pairs as (
  select a.conv_id, a.turn, list_transform(a.w, lambda x: [list_position(list_distinct(a.w || b.w), x)::bigint]) as r,
    list_transform(b.w, lambda x: list_position(list_distinct(a.w || b.w), x)::bigint) as h
  from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
d as (
  select conv_id, turn, len(r) as n, len(h) as m, list_extract(list_reduce(r,
    lambda prev, x: list_reduce(list_transform(range(1, len(h) + 1), lambda j: [j::bigint]),
      lambda cur, j: list_append(cur, least(prev[j[1] + 1] + 1, cur[j[1]] + 1, prev[j[1]] + (case when x[1] = h[j[1]] then 0 else 1 end))), [prev[1] + 1]),
    range(0, len(h) + 1)), -1)::bigint as distance
  from pairs)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).select("conv_id", "turn", T.eval_tokens(F.col("text")).alias("w"))
    after = turns.select(F.col("conv_id"), (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    # What is done with a pair costs far more than its join, so partitions are not to be merged by their bytes.
    dealt = (df.repartition(_tasks(spark), "conv_id", "turn") for df in (turns, after))
    return next(dealt).join(next(dealt), ["conv_id", "turn"])


@query(_PAIRS + "select conv_id, turn, distance, round(distance / n, 9) as wer from d where n > 0")
def turn_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rates of consecutive turns, the earlier as the reference."""
    pairs = _pairs(spark, sf_dir).filter(F.size("w") > 0).withColumn("distance", evaluate.word_distance(F.col("w"), F.col("v")).cast("long"))
    return pairs.select("conv_id", "turn", "distance", F.round(evaluate.error_rate(F.col("w"), F.col("v"), F.col("distance")), 9).alias("wer"))


_CELL = 1 << 20  # a cell of the table holds its distance, times this, and the words matched on the way that is preferred


@query(
    _PAIRS.split("d as (")[0]
    + f"""m as (
  select conv_id, turn, len(r) as words, list_extract(list_reduce(r,
    lambda prev, x: list_reduce(list_transform(range(1, len(h) + 1), lambda j: [j::bigint]),
      lambda cur, j: list_append(cur, case when x[1] = h[j[1]] then prev[j[1]] + 1
        when prev[j[1]] // {_CELL} <= least(prev[j[1] + 1], cur[j[1]]) // {_CELL} then prev[j[1]] + {_CELL}
        when prev[j[1] + 1] // {_CELL} <= cur[j[1]] // {_CELL} then prev[j[1] + 1] + {_CELL} else cur[j[1]] + {_CELL} end), [prev[1] + {_CELL}]),
    list_transform(range(0, len(h) + 1), lambda j: j * {_CELL})), -1)::bigint as cell
  from pairs)
select conv_id, turn, cell // {_CELL} as distance, cell % {_CELL} as matched, words::int as words from m where words > 0"""
)
def aligned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of consecutive turns that the preferred optimal alignment matches, and its cost."""
    pairs = _pairs(spark, sf_dir).filter(F.size("w") > 0).withColumn("m", evaluate.matched("w", "v"))
    hits = F.size(F.filter("m.of_a", lambda x: x)).cast("long")
    return pairs.select("conv_id", "turn", evaluate.word_distance(F.col("w"), F.col("v")).cast("long").alias("distance"), hits.alias("matched"), F.size("w").alias("words"))


@query()
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of consecutive turns that an optimal alignment matches, and the spans that differ between anchors."""
    pairs = _pairs(spark, sf_dir).withColumn("m", evaluate.matched("w", "v"))
    hits = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    return pairs.select("conv_id", "turn", hits(F.col("m.of_a")).alias("matched"), F.size("w").alias("words"), evaluate.differing_spans(F.col("w"), F.col("v"), most=20).alias("spans"))


@query()
def word_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return pairs.select("conv_id", "turn", evaluate.agreement(F.array_join("w", " "), F.array_join("v", " ")).alias("agreement"))


_STAMP = "strftime(timestamp '2026-09-06 12:00:00' + to_seconds(turn * 240), '%Y-%m-%dT%H-%M-%SZ')"


@query(
    f"""
with t as (select conv_id, turn, text, {_EVAL} as w, timestamp '2026-09-06 12:00:00' + to_seconds(turn * 240) as rec, {_STAMP} as stem from conversations),
clips as (select *, row_number() over (partition by conv_id order by stem desc) as nth from t),
pairs as (
  select d.conv_id, d.turn, c.stem, c.rec, d.rec as heard, len(c.w) as n,
    list_transform(c.w, lambda x: [list_position(list_distinct(c.w || d.w), x)::bigint]) as r,
    list_transform(d.w, lambda x: list_position(list_distinct(c.w || d.w), x)::bigint) as h
  from t d join clips c on c.conv_id = d.conv_id and c.nth <= 10 and c.turn % 5 <> 4 and len(c.w) > 0 and len(d.w) > 0 and length(d.text) <= 20000
  where epoch(d.rec) + 60 - epoch(c.rec) between -60 and 1800 and abs(len(c.w) - len(d.w)) <= greatest(2, ceil(len(c.w) * 0.3))),
scored as (
  select conv_id, turn, stem, rec, heard, list_extract(list_reduce(r,
    lambda prev, x: list_reduce(list_transform(range(1, len(h) + 1), lambda j: [j::bigint]),
      lambda cur, j: list_append(cur, least(prev[j[1] + 1] + 1, cur[j[1]] + 1, prev[j[1]] + (case when x[1] = h[j[1]] then 0 else 1 end))), [prev[1] + 1]),
    range(0, len(h) + 1)), -1) / n as difference
  from pairs),
best as (select * from scored where difference <= 0.35 and not (difference = 0 and turn % 2 = 0) qualify row_number() over (partition by conv_id, turn order by difference, rec desc, stem desc) = 1)
select conv_id, turn, stem, round(difference, 9) as difference from best qualify row_number() over (partition by conv_id, stem order by heard, conv_id || '-' || turn) = 1
"""
)
def corpus_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as dictations, a minute after they were recorded, matched with the newest clips of their conversation; every other one comes from a clip, every fifth clip has its label."""
    at = F.timestamp_seconds(F.lit(1788696000) + F.col("turn") * 240)
    turns = _turns(spark, sf_dir).withColumn("rec", at)
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    asked = turns.select(key.alias("dictation"), F.col("conv_id").alias("owner"), F.timestamp_seconds(F.unix_timestamp("rec") + 60).alias("at"), F.when(F.col("turn") % 2 == 0, "clip").otherwise("hook").alias("source"), "text", T.eval_tokens(F.col("text")).alias("words"))
    clips = turns.select(F.col("conv_id").alias("owner"), N.stamp(F.col("rec")).alias("stem"), F.col("rec").alias("recorded"), T.eval_tokens(F.col("text")).alias("words"), F.when(F.col("turn") % 5 == 4, F.col("text")).alias("reference"))
    found = evaluate.match_clips(asked, clips)
    return found.select(F.col("owner").alias("conv_id"), F.element_at(F.split("dictation", "-"), -1).cast("long").alias("turn"), "stem", F.round("difference", 9).alias("difference"))


# Scores and gates


@query(
    """
select event_type, count(*) filter (low)::bigint as n_low, count(*) filter (not low)::bigint as n_high,
  round((sum(w) filter (low)) / (count(*) filter (low) * count(*) filter (not low)), 9) as auc
from (select event_type, user_id % 2 = 0 as low,
    (count(*) filter (user_id % 2 = 1) over (partition by event_type order by value range between unbounded preceding and unbounded following)
     - count(*) filter (user_id % 2 = 1) over (partition by event_type order by value range between unbounded preceding and current row))
    + 0.5 * count(*) filter (user_id % 2 = 1) over (partition by event_type, value) as w
  from events where value is not null)
group by event_type
"""
)
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far values of even users lie below those of odd ones, for each type of event."""
    events = _table(spark, sf_dir, "events").filter(F.col("value").isNotNull()).withColumn("low", F.col("user_id") % 2 == 0)
    return evaluate.separation(events, "value", "low", "event_type").withColumn("auc", F.round("auc", 9))


@query(
    """select event_type, count(*)::bigint as n, count(*) filter (value < 20)::bigint as flagged, count(*) filter (value < 20 and user_id % 2 = 0)::bigint as caught,
    count(*) filter (user_id % 2 = 0)::bigint as n_positive, round(median(value), 9) as median from events group by event_type"""
)
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("low", F.col("user_id") % 2 == 0)
    counts = evaluate.gate_counts(events, "value", "low", 20.0, "event_type")
    return counts.join(evaluate.medians(events, "value", "event_type"), "event_type").withColumn("median", F.round("median", 9))


# Decoding


@query(
    """select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events)
    where event_type <> 'view' and event_type is distinct from previous"""
)
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return decode.ctc_collapse(events, "event_type", "view", ["ts", "event_id"], "user_id").select("event_id", "user_id", "event_type")


@query(
    """
with f as (select *, list_transform(range(0, 8), lambda i: embedding[8 * i + 1:8 * i + 8]) as frames from embeddings),
ids as (select vec_id, list_transform(frames, lambda f: 8 - list_position(list_reverse(f), list_max(f))) as ids from f)
select vec_id, list_transform(list_filter(range(1, 9), lambda i: ids[i] <> 0 and (i = 1 or ids[i] <> ids[i - 1])), lambda i: ids[i]::int) as ids from ids
"""
)
def ctc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as eight frames of eight logits."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", 8 * i + 1, 8))
    return _table(spark, sf_dir, "embeddings").select("vec_id", decode.ctc_ids(frames).alias("ids"))


@query(
    """
with e as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
s as (select vec_id, e, list_max(e) as top, list_sum(list_transform(e, lambda x: exp(x - list_max(e)))) as total from e)
select vec_id, (list_position(e, top) - 1)::int as first, (len(e) - list_position(list_reverse(e), top))::int as last,
  round(exp(e[4] - top) / total, 9) as p_at_3, round(1 / total, 9) as p1, round(exp(list_sort(e, 'desc')[2] - top) / total, 9) as p2 from s
"""
)
def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners (first and last of equal ones), the probability of one place, and the best two."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    two = N.top_two(F.col("e"))
    return rows.select(
        "vec_id", N.argmax_first(F.col("e")).alias("first"), N.argmax_last(F.col("e")).alias("last"), F.round(N.softmax_at(F.col("e"), F.lit(3)), 9).alias("p_at_3"),
        F.round(two["p1"], 9).alias("p1"), F.round(two["p2"], 9).alias("p2"),
    )


def _tokens(spark: SparkSession, sf_dir: str, mark: str) -> DataFrame:
    """A user's events as word pieces: a view begins a word, an error is a comma."""
    events = _table(spark, sf_dir, "events").filter(F.col("value").isNotNull())
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    piece = F.when(F.col("event_type") == "view", F.concat(F.lit(mark), F.col("event_type"))).when(F.col("event_type") == "error", ",").otherwise(F.col("event_type"))
    p = F.col("value") / 1000
    return events.select("user_id", pos.alias("pos"), piece.alias("piece"), p.alias("p"), p.alias("p1"), (p / 2).alias("p2"))


def _tokens_sql(mark: str) -> str:
    return f"""
with k as (select user_id, row_number() over (partition by user_id order by ts, event_id) as pos, event_type, value / 1000 as p from events where value is not null),
w as (select *, sum(case when event_type = 'view' or pos = 1 then 1 else 0 end) over (partition by user_id order by pos) as word,
  case event_type when 'view' then '{mark}view' when 'error' then ',' else event_type end as piece from k)
"""


@query(
    _tokens_sql(" ")
    + """select user_id, (row_number() over (partition by user_id order by word) - 1)::int as index, t as word, round(c, 9) as confidence
    from (select user_id, word, ltrim(string_agg(piece, '' order by pos)) as t, coalesce(min(p) filter (event_type <> 'error'), 1.0) as c from w group by user_id, word)"""
)
def word_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.word_confidences(_tokens(spark, sf_dir, " "), "user_id").withColumn("confidence", F.round("confidence", 9))


@query(
    _tokens_sql("▁")
    + """select user_id, (row_number() over (partition by user_id order by word) - 1)::int as index, t as word, round(a, 9) as p1, round(b, 9) as margin
    from (select user_id, word, string_agg(replace(piece, '▁', ''), '' order by pos) as t, least(1.0, coalesce(min(p) filter (event_type <> 'error'), 1.0)) as a,
      least(1.0, coalesce(min(p - p / 2) filter (event_type <> 'error'), 1.0)) as b from w group by user_id, word) where regexp_matches(t, '[\\p{L}\\p{N}]')"""
)
def word_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode.word_margins(_tokens(spark, sf_dir, "▁"), "user_id")
    return found.withColumn("p1", F.round("p1", 9)).withColumn("margin", F.round("margin", 9))


@query(
    """select user_id, trim(string_agg(case event_type when 'view' then ' view' when 'error' then ',' else event_type end, '' order by ts, event_id)) as text
    from events group by user_id"""
)
def detokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces looked up by id in a vocabulary and joined."""
    ids = {"view": 0, "click": 1, "purchase": 2, "signup": 3, "error": 4}
    pieces = spark.createDataFrame([(i, {"view": "▁view", "error": ","}.get(k, k)) for k, i in ids.items()], "id int, piece string")
    event_id = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])[F.col("event_type")]
    tokens = decode.with_pieces(_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", event_id.alias("id")), F.broadcast(pieces))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "piece"))), lambda x: x["piece"])
    return tokens.groupBy("user_id").agg(T.detokenise(in_order).alias("text"))


@query(
    """
with recursive f as (
  select label as clip_id, nth * 3 + k as frame, list_transform(embedding[k * 21 + 1 : k * 21 + 21], lambda x: x::double) as e
  from (select label, embedding, row_number() over (partition by label order by vec_id) - 1 as nth from embeddings), (select unnest(range(3)) as k)),
walk as (
  select distinct clip_id, 0::bigint as place, 0 as held, null::bigint as previous, 0 as given, null::bigint as id, null::bigint as frame, null::double as p from f
  union all
  select clip_id, place + move, case when move > 0 then 0 else kept end, case when token > 0 then token else previous end, given + (token > 0)::int,
    case when token > 0 then token end, place, p
  from (select *, case when skip > 0 then skip when token = 0 or kept >= 10 then 1 else 0 end as move
    from (select *, held + (token > 0)::int as kept
      from (select clip_id, place, held, previous, given, list_position(l[1:16], list_max(l[1:16])) - 1 as token, list_position(l[17:21], list_max(l[17:21])) - 1 as skip,
          1 / list_sum(list_transform(l[1:16], lambda x: exp(x - list_max(l[1:16])))) as p
        from (select w.*, list_transform(e, lambda x, i: x - case when i = w.previous + 1 then 0.5::double else 0::double end) as l
          from walk w join f on f.clip_id = w.clip_id and f.frame = w.place)))))
select clip_id, (given - 1)::int as pos, id, frame, round(p, 9) as p from walk where id is not null
"""
)
def transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy decoding of each label's embeddings, three frames of 21 logits each; the joint network takes frames as they are, less a little for the previous token."""

    def joint(previous, state, frame):
        logits = frame.astype("float64")
        if previous is not None:
            logits[previous] -= 0.5
        return logits, (state or 0) + 1

    rows = _table(spark, sf_dir, "embeddings")
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    parts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.slice("embedding", k * 21 + 1, 21))
    frames = rows.select(F.col("label").alias("clip_id"), nth.alias("nth"), F.posexplode(parts).alias("k", "features")).select("clip_id", (F.col("nth") * 3 + F.col("k")).alias("frame"), "features")
    return decode.decode_clips(frames, lambda x: decode.tdt_greedy(x, joint, width=16, blank=0)).withColumn("p", F.round("p", 9))


# Signals


@query(
    """
with e as (select vec_id, list_transform(embedding, lambda x: x::double) as e, range(1, len(embedding) + 1) as places from embeddings)
select vec_id, round(list_sum(list_transform(places, lambda i: abs((e[least(i + 1, len(e))] - e[greatest(i - 1, 1)]) / 2))), 6) as deltas,
  round(list_sum(list_transform(places, lambda i: abs(case when i > 1 then e[i] - 0.97 * e[i - 1] else e[i] end))), 6) as preemphasised,
  round(sqrt(list_sum(list_transform(e[7:58], lambda x: x * x)) / 52), 6) as rms,
  round(20 * log10(greatest(sqrt(list_sum(list_transform(e[7:58], lambda x: x * x)) / 52), 1e-12)), 6) as db,
  round(list_sum(list_transform(range(1, 9), lambda i: e[i + 1] * i)) + list_sum(list_transform(range(1, 9), lambda i: e[64 - i] * i)), 6) as mirrored, 80 as padded, 5 as windows
from e
"""
)
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as short signals: deltas, preemphasis, level, mirrored ends, padding, overlapping windows."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + F.abs(v))
    padded = N.reflect_pad(F.col("e"), 8)
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0.0), lambda s, i: s + F.get(padded, 8 - i) * i + F.get(padded, 71 + i) * i)
    return rows.select(
        "vec_id", F.round(size(N.deltas(F.col("e"))), 6).alias("deltas"), F.round(size(N.preemphasis(F.col("e"))), 6).alias("preemphasised"), F.round(N.body_rms(F.col("e")), 6).alias("rms"),
        F.round(N.decibels(N.body_rms(F.col("e"))), 6).alias("db"), F.round(ends, 6).alias("mirrored"), F.size(N.zero_pad(F.col("e"))).alias("padded"),
        F.size(N.overlapping_windows(F.col("e"), 20, 13)).alias("windows"),
    )


@query(
    """
with k as (select event_id, user_id, ts, value, greatest(value, max(value) over (partition by user_id) - 8) / 4 + 1 as clamped from events where value is not null)
select event_id, round(clamped, 9) as clamped, round((coalesce(lead(clamped) over w, clamped) - coalesce(lag(clamped) over w, clamped)) / 2, 9) as delta
from k window w as (partition by user_id order by ts, event_id)
"""
)
def frame_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as rows: clamped to their clip's largest, and deltas."""
    events = _table(spark, sf_dir, "events").filter(F.col("value").isNotNull()).select("event_id", "user_id", "ts", F.col("value").alias("clamped"))
    found = signal.row_deltas(signal.clamp_clip(events, "clamped", "user_id"), "clamped", ["ts", "event_id"], "user_id")
    return found.select("event_id", F.round("clamped", 9).alias("clamped"), F.round("delta", 9).alias("delta"))


@query(
    """
with f as (select label as clip_id, row_number() over (partition by label order by vec_id) - 1 as frame, list_sum(list_transform(embedding, lambda x: x::double)) as x from embeddings),
c as (select clip_id, frame, x, frame // 7 as chunk from f union all
  select clip_id, frame, x, frame // 7 + 1 from f where frame % 7 >= 4 and frame // 7 + 1 <= (select max(frame // 7) from f g where g.clip_id = f.clip_id))
select clip_id, chunk::int as chunk, (count(*) + case when chunk = 0 then 3 else 0 end)::int as frames, round(sum(x), 6) as total from c group by clip_id, chunk
"""
)
def chunks_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    frame = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    frames = rows.select(F.col("label").alias("clip_id"), frame.alias("frame"), F.col("embedding").alias("mel"))
    chunks = signal.context_chunks(frames, "clip_id", 64, chunk=7, context=3)
    total = F.aggregate(F.flatten("frames"), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return chunks.select("clip_id", "chunk", F.size("frames").alias("frames"), F.round(total, 6).alias("total"))


def _clips(spark: SparkSession, sf_dir: str, rate: int) -> DataFrame:
    """Each label's embeddings, one behind the other, as a clip."""
    rows = _table(spark, sf_dir, "embeddings")
    samples = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]))
    return rows.groupBy(F.col("label").alias("clip_id")).agg(samples.alias("samples")).withColumn("rate", F.lit(rate))


# Time, reports, catalog


@query(
    """
with e as (select event_id, user_id, ts, case when ts - lag(ts) over w <= interval 60 second then 0 else 1 end as starts from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(starts) over (partition by user_id order by ts, event_id) as s from e)
select user_id, min(ts) as start, max(ts) as "end", count(*)::bigint as n from s group by user_id, s
"""
)
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.capture import idle_sessions as sessions

    return sessions(_table(spark, sf_dir, "events").select("user_id", "ts"), "ts", "user_id")


@query(
    """select event_id, user_id, case when row_number() over (partition by user_id order by ts, event_id) % 2 = 1 then 'pressed' else 'released' end as kind
    from events where event_type in ('view', 'click', 'purchase')"""
)
def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a trigger's presses and releases, read as a toggle."""
    from ..streaming.capture import toggled

    kind = F.when(F.col("event_type").isin("view", "click", "purchase"), "pressed").otherwise("released")
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", kind.alias("kind"))
    return toggled(events, "kind", ["ts", "event_id"], "user_id").select("event_id", "user_id", "kind")


@query(
    """
select event_id, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') as stamp, date_trunc('second', ts) as back, date '1970-01-01' + (event_id % 30000)::int as day,
  format('{:02d}:{:02d}', (event_id * 37 % 9000) // 60, event_id * 37 % 9000 % 60) as clock,
  round((event_id % 5000) * 0.08::double, 6) as seconds, case when event_id % 16000 > 8000 then 16000 - event_id % 16000 else event_id % 16000 end as folded,
  case when length(props) > 8 then substr(props, 1, 8) || '...' else props end as brief from events
"""
)
def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps and back, days, clocks, frame times, folded tones, shortened texts."""
    e = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        "event_id", N.stamp(F.col("ts")).alias("stamp"), N.parse_stamp(N.stamp(F.col("ts"))).cast("timestamp_ntz").alias("back"), N.civil_date(e % 30000).alias("day"), N.clock(e * 37 % 9000).alias("clock"),
        F.round(N.frame_seconds(e % 5000), 6).alias("seconds"), N.folded(e, F.lit(16000)).alias("folded"), T.truncate(F.col("props"), 8).alias("brief"),
    )


@query(
    """select o_orderpriority as engine, count(*)::bigint as clips, round(sum(l_quantity::double * 60), 3) as audio_secs, round(sum(l_quantity::double * (l_linenumber + 2)), 3) as wall_secs,
    round(sum(l_quantity::double * (l_linenumber + 2)) / greatest(sum(l_quantity::double * 60), 0.001), 9) as rtf
    from lineitem join orders on l_orderkey = o_orderkey group by o_orderpriority"""
)
def rtf_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as benchmark runs, priorities as engines."""
    quantity = F.col("l_quantity").cast("double")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", (quantity * 60).alias("audio_secs"), (quantity * (F.col("l_linenumber") + 2)).alias("wall_secs"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("engine"))
    report = corpus.speed_report(lines.join(orders, "l_orderkey"), "engine")
    return report.select("engine", "clips", F.round("audio_secs", 3).alias("audio_secs"), F.round("wall_secs", 3).alias("wall_secs"), F.round("rtf", 9).alias("rtf"))


@query(
    """select floor(sum(n_chars / 15.0) / 60)::bigint as minutes, 120 as goal, floor(sum(n_chars / 15.0) / 60)::bigint || ' completed towards 120 goal' as line from documents"""
)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.progress(_table(spark, sf_dir, "documents").select((F.col("n_chars") / 15.0).alias("seconds")))


@query(
    """select conv_id, string_agg(trim(text, E' \\n\\t\\r'), E'\\n\\n' order by turn) filter (trim(text, E' \\n\\t\\r') <> '') as text, count(*)::bigint as windows from conversations group by conv_id"""
)
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as windows of a recording, put together."""
    return corpus.transcripts(_turns(spark, sf_dir).withColumnRenamed("turn", "window"), "conv_id")


@query("select conv_id, turn from conversations qualify row_number() over (partition by conv_id order by lpad(turn::varchar, 6, '0') desc) <= 10")
def newest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _turns(spark, sf_dir).withColumn("stem", F.lpad(F.col("turn").cast("string"), 6, "0"))
    return corpus.newest(entries, group="conv_id").select("conv_id", "turn")


@query("select doc_id, '# Title ' || doc_id || chr(10) || text as text from documents")
def markdown_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts written as Markdown with a header and two headings, and read back: header and first heading go."""
    docs = _table(spark, sf_dir, "documents")
    body = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    page = documents.transcript_markdown(F.lit("a.wav"), F.lit("engine"), F.lit(10.0), F.lit(1.0), F.lit(1), F.lit("2026-09-06T12-00-00Z"), F.lit("first"), body)
    return docs.select("doc_id", F.regexp_replace(documents.markdown_body(page), r"\A\n*|\n\z", "").alias("text"))


@query(
    """select page_id, array_to_string(list_filter(list_transform(list_filter(string_split(replace(html, '<p>', '<c>'), chr(10)), lambda l: contains(l, '<c>')),
    lambda l: trim(regexp_replace(l, '<[^>]*>', '', 'g'))), lambda l: l <> ''), ' ') as text from pages"""
)
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captions: their paragraphs as timed words."""
    return _table(spark, sf_dir, "pages").select("page_id", documents.caption_text(F.replace("html", F.lit("<p>"), F.lit("<c>"))).alias("text"))


@query("""select conv_id, turn, case when turn % 2 = 0 then trim(text, E' \\n\\t\\r') else to_json({'prompt': turn})::varchar end as text from conversations""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even turns as JSON with a text prompt, odd ones with a number."""
    raw = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("prompt")))).otherwise(F.to_json(F.struct(F.col("turn").alias("prompt"))))
    return _turns(spark, sf_dir).select("conv_id", "turn", T.unwrap_prompt(raw).alias("text"))


@query(
    """
with f as (select n_nationkey as k, n_regionkey as b from nation),
d as (select k, b, case k % 3 when 0 then 'granite-' when 1 then 'parakeet-' else 'other-' end || k as dir from f)
select case k % 3 when 0 then 'granite' else 'parakeet' end as kind, '/m/' || b || '/' || dir as path, case when k % 2 = 0 then 'int4' else 'fp32' end as variant,
  case k % 3 when 0 then 'Granite Speech 5 TurboCTC' else 'Parakeet TDT' end || case when k % 2 = 0 then ' (int4)' else ' (fp32)' end as label,
  (row_number() over (order by b, case k % 3 when 0 then 2 else 0 end, '/m/' || b || '/' || dir) - 1)::int as ord
from d where k % 3 <> 2
"""
)
def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of directories, one for each nation, in the base directory of its region."""
    k = F.col("n_nationkey")
    name = F.concat(F.when(k % 3 == 0, "granite-").when(k % 3 == 1, "parakeet-").otherwise("other-"), k.cast("string"))
    graph = F.when(k % 2 == 0, ".int4.onnx").otherwise(".onnx")
    files: Column = F.when(k % 3 == 0, F.array(F.concat(F.lit("model"), graph), F.lit("tokenizer.json"))).otherwise(
        F.array(F.concat(F.lit("encoder-model"), graph), F.lit("decoder_joint-model.onnx"), F.lit("vocab.txt"))
    )
    rows = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("base_ord"), F.concat(F.lit("/m/"), F.col("n_regionkey").cast("string"), F.lit("/"), name).alias("path"), name.alias("dir"), F.explode(files).alias("file"), F.lit(False).alias("is_base"))
    return catalog.models(rows).select("kind", "path", "variant", "label", "ord")


from . import learning, signals, speech  # noqa: E402, F401  register their queries
