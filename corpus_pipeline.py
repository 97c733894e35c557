"""A corpus pipeline: language ID, line dedup, near copies, decontamination, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the documents it keeps, with the columns of documents; the last
returns one row per copy that the mix takes. ``run`` writes each stage's
result to the shared folder and reads it again for the next.

The stages handle nulls, empty and very long texts, ties, repeated rows, empty
tables and further columns as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textpool.llm import decontam, langid, line_dedup, mixing, ngram_join
from textpool.llm.common import materialise
from textpool.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows whose text no learned language explains go."""
    return langid.keep_identified(spark, docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: repeated lines go from all documents but the first."""
    return line_dedup.drop_repeated_lines(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near copies stays."""
    return ngram_join.keep_one_of_each(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    return decontam.drop_contaminated(spark, docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: copies of documents, by source weights, with the columns epoch and words."""
    return mixing.mix_documents(spark, docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_copies", near_copies),
          ("decontaminate", decontaminate), ("mix_sources", mix)]

#: The first stage's decisions come from trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
