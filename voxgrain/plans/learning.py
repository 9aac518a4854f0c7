"""Queries over what corrects a recogniser: favoured phrases, near terms, learned aliases."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aliases, boost, decode, fuzzy, vocabulary
from ..session import folder
from .registry import _table, query


@query(
    """
with recursive ph as (
  select list(distinct a * 16 + b) as pairs, list(distinct a) as firsts, greatest(1.0, least(3.5, 3.5 - log10(count(distinct a * 16 + b) / 5.0)))::double as s
  from (select n_nationkey % 15 + 1 as a, (n_regionkey * 3 + n_nationkey) % 15 + 1 as b from nation)),
f as (select vec_id, list_transform(embedding, lambda x: x::double * 20) as e from embeddings),
w as (
  select vec_id, 0 as frame, 0 as held, 0 as st, 0::bigint as tok, 0 as given, null::bigint as id from f
  union all
  select vec_id, case when best = 0 or held >= 1 then frame + 1 else frame end, case when best = 0 or held >= 1 then 0 else held + 1 end,
    case when best = 0 then st when eff = 1 and list_contains(pairs, tok * 16 + best) then 2 when list_contains(firsts, best) then 1 else 0 end,
    case when best = 0 then tok else best end, given + (best > 0)::int, case when best > 0 then best end
  from (
    select *, list_position(v, list_max(v)) - 1 as best
    from (
      select *, list_transform(range(16), lambda k: l[k + 1] + case when k = 0 or len(list_filter(l, lambda y: y > l[k + 1])) >= 5 then 0
        else case when st = 2 and eff = 1 then s else 0 end
          + case when eff = 1 and list_contains(pairs, tok * 16 + k) then s * (2 + ln(2)) else case when eff = 1 then -s else 0 end + case when list_contains(firsts, k) then s else 0 end end end) as v
      from (
        select w.vec_id, frame, held, st, tok, given, pairs, firsts, s, e[frame * 16 + 1 : frame * 16 + 16] as l,
          case when st = 2 then list_contains(firsts, tok)::int else st end as eff
        from w join f on f.vec_id = w.vec_id, ph where frame < 4))))
select vec_id, given - 1 as pos, id, (frame - (held = 0)::int)::int as frame from w where id is not null
"""
)
def boosted_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as four frames of 16 logits, decoded with phrases of two tokens favoured; the nations give the phrases."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    rows = _table(spark, sf_dir, "nation").select((key % 15 + 1).alias("a"), ((region * 3 + key) % 15 + 1).alias("b")).collect()
    phrases = boost.Phrases([(r.a, r.b) for r in rows])
    frames = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, 16))).alias("frame", "features"))
    joint = boost.boosted(lambda previous, state, frame: (np.asarray(frame, float) * 20, state), phrases, blank=0)
    found = decode.decode_clips(frames, partial(decode.rnnt_greedy, joint=joint, blank=0, most=2), "vec_id")
    return found.select("vec_id", "pos", F.col("id").cast("long").alias("id"), "frame")


_COMMON = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(vocabulary.COMMON_ENGLISH))
_WORDS = "unnest(regexp_extract_all(text, '[A-Za-z]+'))"


@query(
    f"""
with terms as (select upper(w) as term, row_number() over (order by count(*) desc, w) as line_no from (select lower({_WORDS}) as w from benchmark) where length(w) >= 6 group by w order by 2 limit 100),
said as (select conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') as ws from conversations),
words as (select conv_id, turn, unnest(ws) as word, unnest(range(len(ws))) as i from said),
rows as (select *, lower(word) as core, (i * 7 + turn) % 10 < 5 as unsure from words),
pairs as (select a.conv_id, a.turn, a.i, a.core || b.core as core, a.unsure and b.unsure as unsure from rows a join rows b on a.conv_id = b.conv_id and a.turn = b.turn and b.i = a.i + 1),
asked as (
  select distinct core, unsure, joined, case when length(core) < 5 or not unsure or core in ({_COMMON}) then 0 when length(core) < 8 then 1 when length(core) >= 12 and joined then 3 else 2 end as most
  from (select core, unsure, false as joined from rows union all select core, unsure, true from pairs)),
near as (
  select core, unsure, joined, arg_min(term, levenshtein(core, lower(term)) * 1000 + line_no) as term
  from asked, terms where levenshtein(core, lower(term)) <= most group by core, unsure, joined),
hits as (select conv_id, turn, i, term, i - row_number() over (partition by conv_id, turn order by i) as run from pairs p join near n on n.core = p.core and n.unsure = p.unsure and n.joined),
made as (select conv_id, turn, i, term from (select *, row_number() over (partition by conv_id, turn, run order by i) as nth from hits) where nth % 2 = 1)
select conv_id, turn, i as "index", term as word, 2 as n from made
union all select r.conv_id, r.turn, r.i, coalesce(n.term, r.word), 1 from rows r left join near n on n.core = r.core and n.unsure = r.unsure and not n.joined
  where not exists (from made m where m.conv_id = r.conv_id and m.turn = r.turn and r.i in (m.i, m.i + 1))
"""
)
def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the turns, some of them unsure, with the hundred most frequent long words of the benchmark as terms in capitals."""
    split = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    counts = _table(spark, sf_dir, "benchmark").select(F.explode(split).alias("w")).groupBy(F.lower("w").alias("w")).count().filter(F.length("w") >= 6)
    top = counts.orderBy(F.desc("count"), "w").limit(fuzzy.MOST_TERMS).collect()
    terms = spark.createDataFrame([(k, r.w.upper()) for k, r in enumerate(top)], "line_no long, term string")
    words = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(split).alias("index", "word"))
    words = words.withColumn("confidence", (F.col("index") * 7 + F.col("turn")) % 10 / 10 - 0.05)
    return fuzzy.repair(words, terms, "conv_id", "turn").select("conv_id", "turn", F.col("index").cast("long").alias("index"), "word", "n")


@query(
    """with s as (select lower(event_type) as heard, 'user ' || (user_id % 40) as meant, count(*)::bigint as n, max(ts) as last from events group by all)
select heard, meant, n from (select *, row_number() over (partition by heard order by n desc, last desc, meant) as nth from s where n >= 3) where nth = 1"""
)
def learned_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings that come in several micro-batches."""
    place = folder(spark, "aliases")
    sightings = _table(spark, sf_dir, "events").select(F.upper("event_type").alias("heard"), F.concat(F.lit("user "), (F.col("user_id") % 40).cast("string")).alias("meant"), F.col("ts").cast("timestamp").alias("at"))
    sightings.repartition(3).write.parquet(f"{place}/in")
    store = aliases.AliasStore(spark, f"{place}/store")
    aliases.learn(spark.readStream.schema(sightings.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in"), store, f"{place}/checkpoint")
    return store.aliases()


def _skeleton(word):
    """Two codes that SQL can say: a word's consonants, and its first letters with its length."""
    low = F.lower(word)
    return F.concat_ws("|", F.regexp_replace(low, "[aeiouyàâäéèêëîïôöùûüç']", ""), F.concat(F.substring(low, 1, 3), F.length(low).cast("string")))


_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_PIECE = r"[\p{L}\p{N}'']+"


@query(
    rf"""
with terms as (
  select upper(w) as term, row_number() over (order by count(*) desc, w) as line_no
  from (select lower(unnest(regexp_extract_all(text, '{_PIECE}'))) as w from benchmark) where length(w) >= 7 group by w order by 2 limit 60),
coded as (select line_no, term, unnest([regexp_replace(lower(term), '[aeiouyàâäéèêëîïôöùûüç'']', '', 'g'), substr(lower(term), 1, 3) || length(term)]) as code from terms),
pieces as (
  select conv_id, turn, unnest(p) as piece, unnest(range(len(p))) as i
  from (select conv_id, turn, regexp_extract_all(text, '{_PIECE}|[^\p{{L}}\p{{N}}'']+') as p from conversations)),
words as (select distinct piece as word from pieces where regexp_full_match(piece, '{_PIECE}') and length(piece) >= 3),
codes as (select word, unnest([regexp_replace(lower(word), '[aeiouyàâäéèêëîïôöùûüç'']', '', 'g'), substr(lower(word), 1, 3) || length(word)]) as code from words where lower(word) not in ({_COMMON})),
exact as (select word, arg_min(term, line_no) as term from words join terms on translate(word, {_ASCII}) = translate(term, {_ASCII}) group by word),
heard as (select word, arg_min(term, line_no) as term from codes join coded using (code) where code <> '' and word not in (select word from exact) group by word),
known as (select * from exact union all select * from heard)
select conv_id, turn, string_agg(coalesce(term, piece), '' order by i) as text, count(term) filter (term <> piece) as changed
from pieces left join known on word = piece group by conv_id, turn"""
)
def coded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the sixty most frequent long words of the benchmark as terms, by spelling, by a simple code for sound, or not at all."""
    split = F.regexp_extract_all("text", F.lit(vocabulary.WORDS))
    counts = _table(spark, sf_dir, "benchmark").select(F.explode(split).alias("w")).groupBy(F.lower("w").alias("w")).count().filter(F.length("w") >= 7)
    top = counts.orderBy(F.desc("count"), "w").limit(60).collect()
    terms = spark.createDataFrame([(k, r.w.upper()) for k, r in enumerate(top)], "line_no long, term string")
    turns = _table(spark, sf_dir, "conversations").filter(F.size(F.regexp_extract_all("text", F.lit(vocabulary.PIECES))) > 0).select("conv_id", "turn", "text", F.col("text").alias("was"))
    fixed = vocabulary.correct_terms(turns, terms, encode=_skeleton)
    words = lambda c: F.regexp_extract_all(c, F.lit(vocabulary.WORDS))
    changed = F.size(F.filter(F.zip_with(words("was"), words("text"), lambda a, b: a != b), lambda x: x))
    return fixed.select("conv_id", "turn", "text", changed.cast("long").alias("changed"))
