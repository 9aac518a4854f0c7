"""From raw documents to a training mix: five stages, each of which works on all that the one before has kept.

1. ``language_id``: documents without a letter, or unlike every learned language, go.
2. ``line_dedup``: lines of recurring templates go, and documents that held nothing else.
3. ``near_duplicates``: one document of each component of linked texts stays.
4. ``decontamination``: documents that cover a benchmark item go.
5. ``mixing``: how many words of each document the mix takes.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Null texts have no language and go with the first stage, as do empty ones; so later stages meet them only if they are run on their own, and
then keep them. Repeated rows are judged alike: the near-duplicate stage leaves one of them. An empty table gives an empty result, and very
long texts are worked on whole. Further columns pass through the first four stages, whatever their names.

Each result is written as Parquet to the shared folder and read again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxgrain.llm.common import Stage, table
from voxgrain.llm.decontaminate import keep_clean
from voxgrain.llm.language_id import keep_identified
from voxgrain.llm.line_dedup import keep_new_lines
from voxgrain.llm.mixing import mix
from voxgrain.llm.set_join import keep_one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in one of the learned languages; those without a letter, or unlike the language they would be in, go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines of recurring templates; rows that held nothing else go."""
    return keep_new_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked texts."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that cover no item of the benchmark."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size and how many words the mix takes of each row."""
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Language identification and string tiling can't be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage.put(step(spark, docs, sf_dir), name)
    return docs
