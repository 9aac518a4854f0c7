"""Secrets by rules: an inverted index of trigrams finds candidates, regular expressions verify them, in DataFrame operations only.

1. Each rule's pattern gives a Boolean trigram query (``trigrams.trigram_query``).
2. The index has a posting list for each trigram that some rule asks for. A list is kept as 64-bit words: row r is bit r mod 64 of
   word r div 64 of its file. The rows of a word lie side by side, so most of a list is made before it moves, and a trigram that all
   documents hold is spread over as many words as there are documents, divided by 64.
3. Lists are intersected and united by bit operations on equal words, which leaves a candidate bit for each row and rule.
4. Candidates are verified by the pattern itself. Rules without mandatory trigrams look at every text.

Spans come from the texts between matches and the matches themselves: their lengths, summed up in a window over one text's matches,
are the places in code points. Only lengths move between tasks; a text is read where it lies.

Rows are named by their place in a Parquet file (``place``); where ``docs`` is no plain scan, its rows are numbered and written
first. Words that hold candidates are broadcast up to ``BROADCAST_WORDS`` of them (24 bytes and more each), and joined beyond.

Defined results: null text is empty; an empty text has no spans. Each row is judged by itself, so repeated rows, equal and null ids
give a row each. Extra columns pass by. An empty table gives an empty result. Whole texts are read, whatever their length.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, table
from .trigrams import ALL, Query, trigram_query

BROADCAST_WORDS = 1_000_000


class Rule(NamedTuple):
    """A span of ``pattern`` counts if its group ``group`` (0: all of it) has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed values. A run of one class is matched to its end, so its least length can be part of the pattern; a key's value is asked for after
#: the match, as a value too short uses its text up.
RULES = (
    Rule("assign", rf"({'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)


def trigram_index(docs: DataFrame, trigrams: Sequence[str], text: str = "text") -> DataFrame:
    """file, word, trigram, bits: posting lists of ``docs`` (file, row and ``text``) in words of 64 rows."""
    low = docs.select("file", F.expr("row div 64").alias("word"), F.expr("shiftleft(1L, cast(row % 64 as int))").alias("bit"), F.lower(F.col(text)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return low.select("file", "word", "bit", F.explode(held).alias("trigram")).groupBy("file", "word", "trigram").agg(F.bit_or("bit").alias("bits"))


def candidates(index: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """file, word, maybe_0, ...: the rows of each word that can match, as bits, for each query; words without any are left out."""
    trigrams = sorted({t for q in queries for a in q for t in a})
    column = {t: f"list_{k}" for k, t in enumerate(trigrams)}
    lists = index.groupBy("file", "word").agg(*[F.coalesce(F.bit_or(F.when(F.col("trigram") == t, F.col("bits"))), F.lit(0).cast("long")).alias(c) for t, c in column.items()])

    def rows(query: Query) -> Column:
        out = F.lit(0).cast("long")
        for alternative in sorted(map(sorted, query)):
            both = F.lit(-1).cast("long")
            for t in alternative:
                both = both.bitwiseAND(F.col(column[t]))
            out = out.bitwiseOR(both)
        return out

    found = lists.select("file", "word", *[rows(q).alias(f"maybe_{k}") for k, q in enumerate(queries)])
    return found.filter(" or ".join(f"maybe_{k} != 0" for k in range(len(queries))))


def _matches(rule: Rule, k: int, maybe: Column, text: Column) -> Column:
    """Of each match: the rule's number, which match it is, the lengths of the text before it, of itself, and of what counts."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("len"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"),
    )
    rows = F.transform(F.filter(zipped, lambda m: m["len"].isNotNull()), lambda m, i: F.struct(F.lit(k).alias("k"), i.alias("i"), m["gap"].alias("gap"), m["len"].alias("len"), m["part"].alias("part")))
    return F.when(maybe & text.rlike(rule.pattern), rows).otherwise(F.expr("array()").cast("array<struct<k:int,i:int,gap:int,len:int,part:int>>"))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", place: tuple[str, str] | None = None, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, file, row, spans of each row of ``docs``: an array of (start, k, end) in order, k being the rule's number.

    ``place`` names two columns, a long for the file and a long for the row in it, that are the same in every scan of ``docs``.
    """
    stage = Stage(docs.sparkSession, "secrets")
    named = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(place or (), ("file", "row"))])
    if not place:
        named = stage.put(named.select("*", F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")), "numbered")
    queries = [trigram_query(r.pattern) for r in rules]
    indexed = [k for k, q in enumerate(queries) if q != ALL]
    maybe = {k: F.lit(True) for k in range(len(rules))}
    if indexed:
        asked = [queries[k] for k in indexed]
        index = stage.put(trigram_index(named, sorted({t for q in asked for a in q for t in a})), "index")
        words = stage.put(candidates(index, asked).withColumnsRenamed({"file": "in_file", "word": "at_word"}), "candidates")
        words = F.broadcast(words) if words.count() <= broadcast_words else words.hint("merge")
        named = named.join(words, (F.col("file") == F.col("in_file")) & (F.expr("row div 64") == F.col("at_word")), "left")
        maybe |= {k: F.expr(f"coalesce(maybe_{n} & shiftleft(1L, cast(row % 64 as int)), 0L) != 0") for n, k in enumerate(indexed)}
    found = F.concat(*[_matches(r, k, maybe[k], F.col("text")) for k, r in enumerate(rules)])
    matches = named.select("doc_id", "file", "row", F.explode_outer(found).alias("m")).select("doc_id", "file", "row", "m.*")
    upto = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("file", "row", "k").orderBy("i"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("k") + 1)
    span = F.when(F.col("part") >= least, F.struct((F.col("end") - F.col("len")).alias("start"), "k", "end"))
    placed = matches.repartition("file", "row").withColumn("end", upto)
    return placed.groupBy("file", "row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans")).select("doc_id", "file", "row", "spans")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    found = find_secrets(docs, place=("file", "row"))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    said = F.transform("spans", lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"], s["end"]))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.k = {k})) as long)").alias(f"n_{r.kind}") for k, r in enumerate(RULES)]
    found = found.select("doc_id", *counts, F.array_join(said, ",").alias("spans"))
    return found.select("doc_id", *[f"n_{r.kind}" for r in RULES], F.sha2("spans", 256).alias("base_sha256"), "spans")


_KINDS = (
    ("assign", RULES[0].pattern.replace("'", "''"), 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
)

OP13_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
found as (
  {" union all ".join(f"select r, {k} as k, '{kind}' as kind, {least} as least, regexp_extract_all(text, '{p}', 0) as f, regexp_extract_all(text, '{p}', {g}) as p, string_split_regex(text, '{p}') as g from d" for k, (kind, p, g, least) in enumerate(_KINDS))}),
rows as (
  select r, k, kind, least, unnest(range(len(f))) as i, unnest(list_transform(f, lambda x: length(x))) as n, unnest(list_transform(p, lambda x: length(x))) as part,
    unnest(list_transform(g[:len(f)], lambda x: length(x))) as gap
  from found where len(f) > 0),
placed as (select *, sum(gap + n) over (partition by r, k order by i) as e from rows),
spans as (
  select r, count(*) filter (where k = 0) as a, count(*) filter (where k = 1) as b, count(*) filter (where k = 2) as c,
    string_agg(kind || ':' || (e - n)::bigint || ':' || e::bigint, ',' order by e - n, k) as spans
  from placed where part >= least group by r)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join spans using (r)"""
