"""Writers. Paths should live under the cluster's shared folder (see ``session.scratch_path``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpool.functions.labels import class_id_of


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8", mode: str = "overwrite") -> None:
    """K1: header CSV; fields are quoted only when needed, quotes doubled, whitespace kept."""
    (df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').option("quote", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("encoding", encoding).csv(path))


def write_json_report(df: DataFrame, path: str) -> None:
    """K2: a (one-row) nested report as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def results_export(pred: DataFrame, path: str, title: str | None = None, keywords: str | None = None) -> None:
    """K3 + P13: ID, Text, Sentiment, Confidence (4dp) plus the trimmed topic title / keywords."""
    from textpool.operators.explore import topic_columns
    out = topic_columns(pred, title, keywords).select(
        F.col("id").alias("ID"), F.col("text").alias("Text"), F.col("sentiment").alias("Sentiment"),
        F.round("confidence", 4).alias("Confidence"), "topic_title", "keywords_subtitle")
    write_csv(out, path)


def stats_export(distribution: DataFrame, path: str) -> None:
    """K4: ``Label,Count`` rows, the total first, then the classes in their order (a row per class: one small file)."""
    ordered = distribution.orderBy(F.desc("is_total"), class_id_of("label").asc_nulls_last(), "label")
    write_csv(ordered.select(F.col("label").alias("Label"), F.col("count").alias("Count")).coalesce(1), path)


def write_run(df: DataFrame, root: str, run_name: str) -> None:
    """K5: ``<root>/run_name=<run>/``; dynamic partition overwrite replaces only this run."""
    (df.withColumn("run_name", F.lit(run_name)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_name").parquet(root))
