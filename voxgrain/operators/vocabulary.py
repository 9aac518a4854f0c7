"""Vocabulary terms in transcripts: exact by spelling, else by Beider-Morse sound, unless the word is ordinary English.

Sounds are encoded in the JVM by the codec library that Spark ships, once for each distinct word and not for each
occurrence. The corrections found are few; up to a checked number they travel as one map and every text is rewritten in
place, without a shuffle of the texts. Beyond that number words are joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import before_terms, capitalize
from ..session import staged

MIN_WORD = 3
#: More corrections than this are joined by shuffle: a map is searched from end to end for each word.
MAP_LIMIT = 1000
#: Words and what lies between them, in turn.
PIECES = r"([\p{IsAlphabetic}\p{N}']+|[^\p{IsAlphabetic}\p{N}']+)"
WORDS = r"([\p{IsAlphabetic}\p{N}']+)"

# Words that are never corrected by sound.
COMMON_ENGLISH = frozenset(
    """about after again all also always and another any anything
    are aren't around back because been before being best better
    between both but call called can can't come could couldn't
    did didn't different does doesn't doing don't done down each
    else enough even ever every everything far few find first
    for from get give going good got great had hadn't has
    hasn't have haven't having her here here's hers him his how
    however i'd i'll i'm i've into isn't it's its just keep
    kind know last least less let let's life like little long
    look lot made make many maybe mean might more most much
    must need never new next not nothing now off often old
    once one only onto other our ours out over own part
    people per place point put quite rather real really right
    said same say see seem seen set she she's should shouldn't
    show side since some something still such sure take than
    that that's the their theirs them then there there's these
    they they'd they'll they're they've thing things think this
    those though thought three through time too two under until
    use used using very want was wasn't way we'd we'll we're
    we've well went were weren't what what's when where whether
    which while who why will with within without won't work
    would wouldn't yes yet you you'd you'll you're you've your
    yours""".split()
)


def beider_morse(word: Column) -> Column:
    """The Beider-Morse codes of a word, joined by ``|``: the JVM encoder as an expression inside generated code."""
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = SparkSession.active()._jvm
    objects, bridge = jvm.org.apache.spark.sql.catalyst.expressions.objects, jvm.org.apache.spark.sql.classic.ExpressionUtils
    single = lambda package, name: getattr(package, f"{name}$").__getattr__("MODULE$")
    nil, none = single(jvm.scala.collection.immutable, "Nil"), single(jvm.scala, "None")
    cls = jvm.java.lang.Class.forName
    string, codec = cls("java.lang.String"), cls("org.apache.commons.codec.language.bm.BeiderMorseEncoder")
    kind = lambda c: jvm.org.apache.spark.sql.types.ObjectType(c)
    seq = lambda x: jvm.org.apache.spark.api.python.PythonUtils.toSeq([x])
    java = objects.Invoke(bridge.expression(word._jc), "toString", kind(string), nil, nil, True, True, True)
    encoder = objects.NewInstance(codec, nil, nil, False, kind(codec), none)
    codes = objects.Invoke(encoder, "encode", kind(string), seq(java), nil, True, True, True)
    back = objects.StaticInvoke(
        cls("org.apache.spark.unsafe.types.UTF8String"), single(jvm.org.apache.spark.sql.types, "StringType"), "fromString", seq(codes), nil, True, True, True, none
    )
    return ClassicColumn(bridge.column(back))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """line_no, term: one term a line; blank lines and those that begin with ``#`` are left out. The order of lines counts.

    A missing file has no terms.
    """
    empty = spark.createDataFrame([], "line_no long, term string")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "raw"))
    term = F.regexp_replace("raw", r"(?U)^\s+|\s+\z", "")
    return lines.select(F.col("line_no").cast("long"), term.alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#"))


#: A word's codes, joined by ``|``.
Encode = Callable[[Column], Column]


def encoded_terms(terms: DataFrame, encode: Encode = beider_morse) -> DataFrame:
    """line_no, term, codes."""
    return terms.select("line_no", "term", F.split(encode(F.col("term")), r"\|").alias("codes"))


def corrections(words: DataFrame, terms: DataFrame, encode: Encode = beider_morse) -> DataFrame:
    """word, term: of the distinct ``words`` (word), those that a term replaces by another spelling."""
    long = words.filter(F.length("word") >= MIN_WORD)
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spelled = terms.groupBy(lower(F.col("term")).alias("key")).agg(F.min_by("term", "line_no").alias("exact"))
    found = long.withColumn("key", lower(F.col("word"))).join(spelled, "key", "left")
    same = found.filter(F.col("exact").isNotNull()).select("word", F.col("exact").alias("term"))
    open_ = found.filter(F.col("exact").isNull() & ~F.lower("word").isin(*sorted(COMMON_ENGLISH))).select("word")
    # To encode a word costs far more than to move it, so partitions are not to be merged by their bytes.
    spark = words.sparkSession
    open_ = open_.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "word")
    sounds = open_.select("word", F.explode(F.split(encode(F.col("word")), r"\|")).alias("code")).filter(F.col("code") != "")
    by_code = encoded_terms(terms, encode).select("line_no", "term", F.explode("codes").alias("code"))
    heard = sounds.join(by_code, "code").groupBy("word").agg(F.min_by("term", "line_no").alias("term"))
    return same.unionByName(heard).filter(F.col("word") != F.col("term"))


def correct_terms(df: DataFrame, terms: DataFrame, text: str = "text", map_limit: int = MAP_LIMIT, encode: Encode = beider_morse) -> DataFrame:
    """``df`` with the words of ``text`` replaced by the vocabulary's terms; what stands between words is kept as it is."""
    words = df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(WORDS)))).alias("word")).distinct()
    found = staged(corrections(words, terms, encode), "corrections")
    some = found.limit(map_limit + 1).collect()
    if len(some) <= map_limit:
        if not some:
            return df
        spark = df.sparkSession
        known = spark.createDataFrame([(dict((r["word"], r["term"]) for r in some),)], "known_ map<string,string>")
        pieces = F.regexp_extract_all(F.col(text), F.lit(PIECES))
        fixed = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at("known_", p), p)), "")
        return df.crossJoin(F.broadcast(known)).withColumn(text, F.when(F.col(text).isNotNull(), fixed)).drop("known_")
    keyed = df.withColumn("row_", F.xxhash64(F.col(text)))
    parts = keyed.select("row_", F.col(text).alias("text_")).dropDuplicates(["row_"]).select("row_", F.posexplode(F.regexp_extract_all("text_", F.lit(PIECES))).alias("at", "piece"))
    joined = parts.join(found, F.col("piece") == F.col("word"), "left").groupBy("row_")
    texts = joined.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("term", "piece").alias("p")))), lambda x: x["p"]), "").alias("fixed_"))
    return keyed.join(texts, "row_", "left").withColumn(text, F.coalesce("fixed_", text)).drop("row_", "fixed_")


def fix_with_terms(df: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` repaired: the passes before, the vocabulary, capitals."""
    repaired = correct_terms(df.withColumn(text, before_terms(F.col(text))), terms, text)
    return repaired.withColumn(text, capitalize(F.col(text)))
