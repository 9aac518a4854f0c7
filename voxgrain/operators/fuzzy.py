"""Vocabulary terms in words that a recogniser was not sure of, and terms that it split in two.

A word is given a term's spelling where it is the term but for case; or, if its confidence is below the gate, where it is near enough to it. Two words in a row
become a term that they spell when joined; if both are below the gate, also one that they nearly spell. Words that were sure are never changed by likeness.

Near terms are found without comparing all pairs: two strings within d edits have a string in common that either becomes by leaving out d characters at most. Words and
terms are listed under these strings, meet by an equal join, and are verified by their edit distance. Above ``MOST_TERMS`` terms, likeness is off and spelling stays;
so the terms' list has a fixed bound and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from .vocabulary import COMMON_ENGLISH

# The gate, the longest list of terms, and lengths from which words may differ by one, two and, if joined, three edits.
GATE, MOST_TERMS = 0.45, 100
LENGTHS = (5, 8, 12)
#: Rows of one word meet its term in so many places, and rows that ask for no term in as many as there are: most rows ask for none, and would be one task's.
DEALS = 16
_CORE = r"\A([^\p{L}\p{N}]*)([\p{L}\p{N}](?:.*[\p{L}\p{N}])?)([^\p{L}\p{N}]*)\z"


def allowed(word: Column, joined: Column) -> Column:
    """The edits by which a word may differ from a term."""
    n = F.length(word)
    return F.when(n < LENGTHS[0], 0).when(n < LENGTHS[1], 1).when((n >= LENGTHS[2]) & joined, 3).otherwise(2)


def shortened(word: Column, most: Column) -> Column:
    """The strings that a word becomes by leaving out up to ``most`` characters, three at most; itself included."""

    def fewer(words: Column) -> Column:
        one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), one)))

    out = level = F.array(word)
    for k in range(1, 4):
        level = F.when(most >= k, fewer(level)).otherwise(F.expr("cast(array() as array<string>)"))
        out = F.concat(out, level)
    return F.array_distinct(out)


def near_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word, most, term, edits: of the distinct ``words`` (word, most: edits allowed), the nearest of ``terms`` (line_no, term), of equal ones the first; all in lower case but the terms."""
    index = terms.select("line_no", "term", F.lower("term").alias("key"))
    lengths = index.select(F.length("key").alias("n_")).distinct()
    index = index.select("*", F.explode(shortened(F.col("key"), F.least(F.lit(3), F.greatest(F.length("key") - LENGTHS[0] + 2, F.lit(0))))).alias("short"))
    # Edits change a word's length by their number at most: words that no term has the length for are not listed.
    sizes = [r["n_"] for r in lengths.collect()]
    fits = F.exists(F.array(*map(F.lit, sizes)), lambda n: F.abs(F.length("word") - n) <= F.col("most")) if sizes else F.lit(False)
    # To list a word costs far more than to move it, so partitions are not to be merged by their bytes.
    spark = words.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = words.select("word", "most").distinct().filter(fits).repartition(tasks, "word")
    asked = asked.select("*", F.explode(shortened(F.col("word"), F.col("most"))).alias("short"))
    met = asked.join(F.broadcast(index), "short").withColumn("edits", F.levenshtein("word", "key")).filter(F.col("edits") <= F.col("most"))
    best = met.groupBy("word", "most").agg(F.min(F.struct("edits", "line_no", "term")).alias("best"))
    return best.select("word", "most", "best.term", "best.edits")


def repair(words: DataFrame, terms: DataFrame, *clip: str, gate: float = GATE, most_terms: int = MOST_TERMS) -> DataFrame:
    """clip, index, word, n: ``words`` (clip, index, word, confidence) with terms put right; n is 2 where a word stands for two.

    Marks around a word stay. Of joins that share a word the first in the row is made, then every other one. Null confidences are below no gate.
    """
    likeness = terms.limit(most_terms + 1).count() <= most_terms
    core = F.regexp_extract("word", _CORE, 2)
    rows = words.select(*clip, "index", "word", "confidence", F.regexp_extract("word", _CORE, 1).alias("before_"), F.lower(core).alias("core_"), F.regexp_extract("word", _CORE, 3).alias("after_"))
    unsure = F.coalesce(F.col("confidence") < gate, F.lit(False))
    spelled = terms.groupBy(F.lower("term").alias("key_")).agg(F.min_by("term", "line_no").alias("exact_"))
    spelled = F.broadcast(spelled) if likeness else spelled

    def found(candidates: DataFrame, key: str, may: Column, joined: bool) -> DataFrame:
        """``candidates`` with ``term_``: by spelling, or where they ``may``, by likeness."""
        out = candidates.join(spelled, F.col(key) == F.col("key_"), "left").drop("key_")
        if not likeness:
            return out.withColumnRenamed("exact_", "term_")
        most = allowed(F.col(key), F.lit(joined))
        open_ = F.col("exact_").isNull() & may & (most > 0) & ~F.col(key).isin(*sorted(COMMON_ENGLISH))
        near = near_terms(out.filter(open_).select(F.col(key).alias("word"), most.alias("most")), terms).select(F.col("word").alias("like_"), F.col("term").alias("near_"))
        near = near.withColumn("deal_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
        spread = F.xxhash64(*clip, "index")
        out = out.withColumn("open_", F.when(open_, F.col(key))).withColumn("dealt_", F.when(F.col("open_").isNull(), spread).otherwise(F.pmod(spread, F.lit(DEALS))))
        out = out.join(near, (F.col("open_") == F.col("like_")) & (F.col("dealt_") == F.col("deal_")), "left")
        return out.withColumn("term_", F.coalesce("exact_", "near_")).drop("exact_", "near_", "like_", "open_", "deal_", "dealt_")

    following = rows.select(*clip, (F.col("index") - 1).alias("index"), F.col("word").alias("word2_"), F.col("core_").alias("core2_"), F.col("before_").alias("before2_"), F.col("after_").alias("after2_"), unsure.alias("unsure2_"))
    pairs = rows.withColumn("unsure_", unsure).join(following, [*clip, "index"]).filter((F.col("after_") == "") & (F.col("before2_") == "") & (F.col("core_") != "") & (F.col("core2_") != ""))
    pairs = pairs.withColumn("both_", F.concat("core_", "core2_"))
    joins = found(pairs, "both_", F.col("unsure_") & F.col("unsure2_"), True).filter(F.col("term_").isNotNull())
    turn = F.row_number().over(Window.partitionBy(*clip).orderBy("index"))
    joins = joins.withColumn("run_", F.col("index") - turn)
    joins = joins.withColumn("nth_", F.row_number().over(Window.partitionBy(*clip, "run_").orderBy("index"))).filter(F.col("nth_") % 2 == 1)
    made = staged(joins.select(*clip, "index", F.concat("before_", "term_", "after2_").alias("word"), F.lit(2).alias("n")), "joins")
    taken = made.select(*clip, F.explode(F.array(F.col("index"), F.col("index") + 1)).alias("index"))
    rest = found(rows.join(taken, [*clip, "index"], "left_anti"), "core_", unsure, False)
    word = F.when(F.col("term_").isNotNull(), F.concat("before_", "term_", "after_")).otherwise(F.col("word"))
    return rest.select(*clip, "index", word.alias("word"), F.lit(1).alias("n")).unionByName(made)
