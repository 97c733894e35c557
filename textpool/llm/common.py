"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpool.session import scratch_path

#: White space of every contract here: space and the bytes 09-0D.
SPACES = " \t\n\x0b\x0c\r"
#: A word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null document id; sorts after every real one.
NO_ID = (1 << 63) - 1


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` does the same, and faster, unless the text holds a capital
    letter outside ASCII; only such texts are translated letter by letter.
    """
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    foreign = text.rlike(r"[^\x00-\x7F&&[\p{javaUpperCase}\p{javaTitleCase}]]")
    return F.when(foreign, F.translate(text, capitals, capitals.lower())).otherwise(F.lower(text))


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores added until no column of ``taken`` clashes (case-insensitively)."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def connected(spark: SparkSession, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs): one row ``(node, root)`` per node, root the smallest node.

    Alternates large-star and small-star steps until the edges no longer
    change; each step is one aggregate and one join on a node, written to the
    shared folder. A node with very many edges is aggregated before its rows
    meet and its join partition can be split, so no task holds a whole group.
    No edges give no rows.
    """
    def links(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def step(e: DataFrame, large: bool) -> DataFrame:
        # large star: all neighbours of u, larger ones move to u's smallest; small star: only the smaller ones
        near = links(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        joined = near.join(low, "u")
        if large:
            moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                low.select("u", F.col("m").alias("v")))
        moved = moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        return materialise(spark, moved.distinct(), f"{name}-star")

    edges = materialise(spark, edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    before = None
    while (now := state(edges)) != before and now[0]:
        before = now
        edges = step(step(edges, True), False)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def slabs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``most`` (a larger row is a range of its own)."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes)


__all__ = ["NO_ID", "SPACES", "WORD", "Window", "connected", "free_name", "lower_ascii", "materialise", "n_words", "slabs"]
