"""A catalog of installed models from listings of files: what a directory holds, its variant and its rank, and the modes it offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Families by name prefix, their names in menus, rank, default capture and profile.
KINDS = [
    ("nemotron", "Nemotron Speech Streaming EN", 1, "Toggle", "Raw", "Nemotron Toggle"),
    ("granite", "Granite Speech 5 TurboCTC", 2, "Toggle", "Long", "Granite 5 Toggle"),
    ("parakeet", "Parakeet TDT", 0, "Hold", "Raw", "Parakeet PTT"),
]
# Files that models need beside their graphs.
VOCABULARY, TOKENIZER, TOKENS, FILTERS = "vocab.txt", "tokenizer.json", "tokens.txt", "filterbank.bin"
# Keys of chords.
MODIFIERS = {"W": "LeftMeta", "A": "LeftAlt", "C": "LeftCtrl", "S": "LeftShift"}


def quant_rank(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("int8"), 0).when(low.contains("int4"), 1).otherwise(2)


def variant(name: Column) -> Column:
    return F.element_at(F.array(F.lit("int8"), F.lit("int4"), F.lit("fp32")), quant_rank(name) + 1)


def has_family(directory: Column) -> Column:
    low = F.lower(directory)
    return low.startswith("parakeet") | low.startswith("granite") | low.startswith("nemotron")


def list_files(spark: SparkSession, bases: list[str]) -> DataFrame:
    """base_ord, path, dir, file, length: the files of each base directory and of the directories in it."""
    rows = None
    for i, base in enumerate(bases):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length")
        files = files.select(F.lit(i).alias("base_ord"), F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1).alias("path"), F.element_at(F.split("path", "/"), -1).alias("file"), "length")
        files = files.withColumn("is_base", F.col("path").endswith(base.rstrip("/").removeprefix("file:")))
        rows = files if rows is None else rows.unionByName(files)
    return rows.withColumn("dir", F.element_at(F.split("path", "/"), -1))


def models(files: DataFrame) -> DataFrame:
    """kind, path, variant, label, capture, profile, rank, ord: the models among ``files`` (base_ord, path, dir, file, is_base), best first.

    A directory in a base counts if its name begins with a family; what it holds decides its kind. A path counts once, where it is found first.
    """
    file = F.col("file")
    graph = file.rlike(r"\.onnx\z")
    pick = lambda which: F.min_by(F.when(graph & which, file), F.when(graph & which, F.struct(quant_rank(file), file)))
    encoder, decoder = file.startswith("encoder"), file.startswith("decoder")
    joint = file.startswith("decoder_model") | file.startswith("decoder_joint")
    has = lambda name: F.bool_or(file == name)
    found = (
        files.filter(F.col("is_base") | has_family(F.col("dir")))
        .groupBy("base_ord", "path", "dir")
        .agg(
            pick(encoder).alias("encoder"), pick(decoder).alias("decoder"), pick(joint).alias("joint"), pick(~encoder & ~decoder).alias("single"),
            has(VOCABULARY).alias("vocabulary"), has(TOKENIZER).alias("tokenizer"), has(TOKENS).alias("tokens"), has(FILTERS).alias("filters"),
        )
    )
    kind = (
        F.when(F.col("encoder").isNotNull() & F.col("joint").isNotNull() & F.col("tokens") & F.col("filters"), "nemotron")
        .when(F.col("single").isNotNull() & F.col("tokenizer"), "granite")
        .when(F.col("encoder").isNotNull() & F.col("decoder").isNotNull() & F.col("vocabulary"), "parakeet")
    )
    found = found.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    of_file = F.coalesce(variant(F.when(F.col("kind") == "granite", F.col("single")).otherwise(F.col("encoder"))), F.lit("unknown"))
    found = found.withColumn("variant", F.when((F.col("kind") == "nemotron") & (variant(F.col("dir")) != "fp32"), variant(F.col("dir"))).otherwise(of_file))
    facts = F.create_map(*[x for k, *v in KINDS for x in (F.lit(k), F.struct(*[F.lit(y).alias(n) for y, n in zip(v, ("name", "rank", "capture", "profile", "menu"))]))])
    found = found.withColumn("facts", facts[F.col("kind")]).select("base_ord", "path", "kind", "variant", "facts.*")
    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("base_ord"))).filter(F.col("nth") == 1)
    order = F.row_number().over(Window.orderBy("base_ord", "rank", "path")) - 1
    return first.select("kind", "path", "variant", F.format_string("%s (%s)", "name", "variant").alias("label"), "menu", "capture", "profile", "rank", order.alias("ord"))


def find_mode(modes: DataFrame, wanted: str) -> DataFrame:
    """The first mode whose menu name holds ``wanted``, in any case."""
    return modes.filter(F.lower("menu").contains(wanted.lower())).orderBy("ord").limit(1)


def chord(text: Column) -> Column:
    """struct(modifiers, key) of a chord such as ``W-C-Print``; prefixes that are no modifier belong to the key."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    prefix = F.regexp_extract(trimmed, r"\A((?:[WwAaCcSs]-(?=.))*)", 1)
    names = F.create_map(*[F.lit(x) for pair in MODIFIERS.items() for x in pair])
    parts = F.filter(F.split(prefix, "-"), lambda p: p != "")
    key = F.substr(trimmed, F.length(prefix) + 1)
    return F.when(key != "", F.struct(F.transform(parts, lambda p: names[F.upper(p)]).alias("modifiers"), key.alias("key")))
