"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each source gets a target number of words: its share by weight of a budget, but at most ``MAX_REPEATS``
times what it has; the excess goes to the others by weight until none is above its limit. A source whose
target is k whole passes and a rest takes every document k times and, once more, the documents whose
hash lies below a threshold. The threshold comes from histograms, never from a sort of documents:

1. words by source and leading hash digits (``DIGITS`` hex digits: at most 4096 rows a source);
2. a running sum finds the boundary bucket, in which the rest runs out;
3. only the boundary bucket is summed again by its next digits, ``LEVELS`` times in all;
4. documents are filtered by comparing their hash with the threshold.

The thresholds of growing budgets are nested: what a small budget takes, every larger one takes too.

Defined results: a null text has size 0; a null source is a source of its own, the last in order; rows
that repeat a doc_id share its hash and are taken together; a null doc_id hashes the text instead. A
source without words has target 0. An empty table gives an empty result. The hash is of doc_id alone, so
reruns agree, whatever the partitioning. A source's error is at most half of what one last bucket (of
16**(DIGITS * LEVELS)) holds, half a document in practice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Stage, table

DIGITS, LEVELS = 3, 3
#: Sources by code point, null last, weigh these in turn.
WEIGHTS = (5, 2, 1)
#: The budget, as a multiple of all words, and the most often that a document may be taken.
BUDGET, MAX_REPEATS = 1.5, 2
#: Above this many sources the thresholds are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the hash digits of each document."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.substring(F.md5(key.cast("binary")), 1, DIGITS * LEVELS).alias("h"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: a row for each source of ``sizes`` (source, size).

    The windows hold one row for each source, which is the length of the recipe and not of the corpus.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((n - 1) % len(weights) + 1).cast("int"))
    limit = (F.lit(max_repeats) * F.col("source_size")).cast("double")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select("source", "source_size", n.alias("n"), weight.alias("weight"), limit.alias("limit"))
    # Raise one level for all: a source takes level * weight and stays at its limit from limit / weight on. Each row has the
    # level if all before it were full; it holds for the first row that is not, and is lower in every later one.
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "n")
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    stopped = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rising_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(budget) - stopped) / rising_weight
    per = per.select("*", level.alias("level"))
    common = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(everything)
    return per.select("source", "source_size", F.least(F.col("limit"), F.coalesce(common * F.col("weight"), F.col("limit"))).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame, small=lambda df: df) -> DataFrame:
    """source, passes, edge, with_edge: whole passes of a source, and the last hash bucket of the part pass.

    Buckets below ``edge`` are in; ``edge`` itself is in where that is nearer to the target. ``small`` marks
    tables of one row a source for the join.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = targets.withColumn("passes", passes).select("source", "passes", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"))
    goal = goal.withColumn("edge", F.lit(""))
    for depth in range(1, LEVELS + 1):
        inside = sizes
        if depth > 1:
            at = small(goal.select(F.col("source").alias("s"), "edge"))
            inside = sizes.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.substring("h", 1, DIGITS * (depth - 1)) == F.col("edge")), "left_semi")
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        hist = inside.groupBy("source", F.substring("h", 1, DIGITS * depth).alias("bucket")).agg(F.sum("size").alias("words")).withColumn("upto", upto)
        was = small(goal.select(F.col("source").alias("s"), "passes", "rest"))
        crossed = (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest"))
        goal = hist.join(was, F.col("source").eqNullSafe(F.col("s"))).filter(crossed).select(
            "source", "passes", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), F.col("bucket").alias("edge"), "words"
        )
    return goal.select("source", "passes", "edge", (F.lit(2) * F.col("rest") >= F.col("words")).alias("with_edge"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs`` (doc_id, source, text)."""
    stage = Stage(docs.sparkSession, "mix")
    sizes = stage.put(sized(docs), "sizes")
    targets = stage.put(source_targets(sizes, weights, budget, max_repeats).coalesce(1), "targets")
    small = F.broadcast if targets.count() <= broadcast_sources else lambda df: df
    edges = stage.put(thresholds(sizes, targets, small).coalesce(1), "edges")
    plan = small(
        targets.select(F.col("source").alias("s"), "source_size", "target")
        .join(small(edges.withColumnRenamed("source", "e")), F.col("s").eqNullSafe(F.col("e")), "left")
        .drop("e")
    )
    more = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.col("with_edge"))
    taken = F.col("size") * (F.coalesce("passes", F.lit(0)) + F.coalesce(more, F.lit(False)).cast("int"))
    return sizes.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def _levels_sql() -> str:
    out = []
    for d in range(1, LEVELS + 1):
        was, n = (f"goal{d - 1}", DIGITS * d)
        inside = "sizes" if d == 1 else f"(select z.* from sizes z join {was} g on z.source is not distinct from g.source and substr(z.h, 1, {n - DIGITS}) = g.edge)"
        out.append(f"""
hist{d} as (
  select source, bucket, words, sum(words) over (partition by source order by bucket) as upto
  from (select source, substr(h, 1, {n}) as bucket, sum(size)::bigint as words from {inside} group by 1, 2)),
goal{d} as (
  select h.source, g.passes, g.rest - h.upto::double + h.words::double as rest, h.bucket as edge, h.words
  from hist{d} h join {was} g on h.source is not distinct from g.source
  where h.upto > g.rest and h.upto - h.words <= g.rest)""")
    return ",".join(out)


def mixing_ctes(documents: str = "documents") -> str:
    """The operator as SQL: the last of these tables, ``mixed``, has its rows."""
    return rf"""
sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    substr(md5(coalesce(doc_id::varchar, md5(text), '')), 1, {DIGITS * LEVELS}) as h
  from {documents}),
per as (
  select source, source_size, n, [{", ".join(map(str, WEIGHTS))}][(n - 1) % {len(WEIGHTS)} + 1] as weight, ({MAX_REPEATS} * source_size)::double as lim
  from (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as n from sizes group by source)),
lev as (
  select *, (sum(source_size) over ()::double * {BUDGET}
      - coalesce(sum(lim) over (order by lim / weight, n rows between unbounded preceding and 1 preceding), 0.0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by lim / weight, n rows between unbounded preceding and 1 preceding), 0))::double as level
  from per),
targets as (
  select source, source_size, least(lim, coalesce(max(level) filter (where level * weight <= lim) over () * weight, lim)) as target
  from lev),
goal0 as (
  select source, passes, greatest(0.0, target - passes * source_size) as rest, '' as edge
  from (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as passes from targets)),{_levels_sql()},
mixed as (
  select z.doc_id, z.size, t.source_size, t.target,
    (z.size * (coalesce(g.passes, 0) + case when z.h < g.edge or (z.h = g.edge and 2 * g.rest >= g.words) then 1 else 0 end))::bigint as taken
  from sizes z join targets t on z.source is not distinct from t.source
  left join goal{LEVELS} g on z.source is not distinct from g.source)"""


OP3_SQL = f"with {mixing_ctes()} select * from mixed"
