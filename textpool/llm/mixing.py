"""Mixing sources to target weights (DataFrame functions only).

Rows get hash-random keys; within a source they are split into key ranges
and sorted by key, range totals give each range's offset, and a running sum
gives every row its place on the source's line of words. The budget is cut
out of that line: whole passes first, then exactly the words that remain.
A source of n rows has about sqrt(n) ranges of sqrt(n) rows, so neither the
ranges nor the line of ranges outgrow a task when one source holds most rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpool.llm.common import free_name, materialise, n_words

MOST_EPOCHS = 3
#: Keys are the first 48 bits of an MD5 of the seed, the id and the text.
KEY_BITS = 48


def row_key(seed: int):
    """Hash-random key of a row: the same on every run and in any partitioning; equal for repeated rows only."""
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                               F.coalesce(F.col("text"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", n_words("text").alias("size"), row_key(seed).alias("key"))


def source_targets(spark: SparkSession, totals: DataFrame, cycle: int = 3, most: int = MOST_EPOCHS) -> DataFrame:
    """totals(source, source_size, n_rows) with ``target``: weights 1..cycle by code point order (null last).

    All sources share the sum of all sizes by weight; a target stops at
    ``most`` times its source's size and the excess is shared by weight among
    the others, again and again until none is above. Each round is one
    aggregate over the sources; only its two sums come to the driver.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = materialise(spark, totals.withColumn(
        "weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double")), "mix-sources")
    limit = F.col("source_size") * float(most)
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, share = None, F.lit(0.0)
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > limit
        held, weight = ranked.agg(F.sum(F.when(capped, limit).otherwise(0.0)),
                                  F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        new = (whole - held) / weight
        share = F.when(capped, limit).otherwise(F.col("weight") * F.lit(new))
        if level is not None and new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(share, limit))


def mix_plan(spark: SparkSession, docs: DataFrame, seed: int = 1, cycle: int = 3,
             most: int = MOST_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """``(rows, sources)`` of the mix of ``docs``.

    rows: doc_id, source, size, source_size, target, epochs, taken (words the
    mix takes of the row, repeats counted), start (words of its source before
    it). sources: source, source_size, target, epochs, and where the budget
    cuts: cut_key, rest, group_size.

    Rows with one key (repeated rows) share the words that fall to them in
    proportion to size, rounded down. Null texts have size 0 and are taken 0
    times. A null source is a source of its own, the last. A source without
    words gets target 0. An empty table gives empty results.
    """
    rows = materialise(spark, sized(docs, seed), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sources = source_targets(spark, totals, cycle, most)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    sources = (sources.withColumn("epochs", epochs)
               .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
               .withColumn("n_ranges", F.ceil(F.sqrt("n_rows"))))
    joined = rows.join(sources.select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", "n_ranges"),
                       F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # equal keys are one row before they are sorted, so any number of repeated rows weighs nothing in a range
    place = F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * F.col("n_ranges")).cast("long")
    keys = joined.withColumn("range", place).groupBy("source", "range", "key").agg(F.sum("size").alias("group_size"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (keys.groupBy("source", "range").agg(F.sum("group_size").alias("range_size"))
               .select(F.col("source").alias("s"), F.col("range").alias("r"),
                       F.coalesce(F.sum("range_size").over(along), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("source", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    starts = (keys.withColumn("before", F.coalesce(F.sum("group_size").over(inside), F.lit(0)))
              .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
              .select(F.col("source").alias("of_source"), F.col("key").alias("of_key"), "group_size",
                      (F.col("offset") + F.col("before")).alias("start")))
    placed = joined.join(starts, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("key") == F.col("of_key"))).drop("of_source", "of_key")
    return placed.withColumn("taken", _taken()), sources


def _taken():
    """Words taken of a row that lies at ``start`` among rows of one key and ``group_size`` words."""
    reach = F.least(F.greatest(F.col("rest") - F.col("start"), F.lit(0)), F.col("group_size"))
    part = F.when(F.col("group_size") > 0, F.expr("size * 1.0D") * reach / F.col("group_size")).otherwise(0.0)
    exact = F.when(reach == F.col("group_size"), F.col("size")).otherwise(F.floor(part).cast("long"))
    return F.col("epochs") * F.col("size") + exact


def mix_documents(spark: SparkSession, docs: DataFrame, seed: int = 1, cycle: int = 3,
                  most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: one row per copy that it takes, with the columns of ``docs`` and ``epoch``, ``words``.

    The text never moves: the key at which a source's budget ends is found on
    sizes alone, and each row compares its own key with it. The copy that the
    budget cuts holds the text up to its last whole word taken; ``n_chars``, if
    there is such a column, is that of the cut text. New columns
    whose names clash get an underscore.
    """
    placed, sources = mix_plan(spark, docs, seed, cycle, most)
    at_cut = placed.filter("start < rest AND start + group_size > rest").groupBy(F.col("source").alias("cut_source")).agg(
        F.min("key").alias("cut_key"), F.min("start").alias("cut_start"), F.min("group_size").alias("cut_size"))
    last = placed.filter("start + group_size <= rest AND size > 0").groupBy(F.col("source").alias("last_source")).agg(
        F.max("key").alias("last_key"))
    cuts = (sources.join(at_cut, F.col("source").eqNullSafe(F.col("cut_source")), "left")
            .join(last, F.col("source").eqNullSafe(F.col("last_source")), "left")
            .select(F.col("source").alias("m_source"), "epochs", "rest", "cut_key", "cut_start", "cut_size", "last_key"))
    cuts = materialise(spark, cuts, "mix-cuts")
    epoch, words = free_name(docs.columns, "epoch"), free_name(docs.columns, "words")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("m_row_source"),
                       n_words("text").alias("m_size"), row_key(seed).alias("m_key"))
    joined = rows.join(cuts, F.col("m_row_source").eqNullSafe(F.col("m_source")))
    part = F.floor(F.expr("m_size * 1.0D") * (F.col("rest") - F.col("cut_start")) / F.col("cut_size")).cast("long")
    extra = (F.when(F.col("m_key") <= F.col("last_key"), F.col("m_size"))
             .when(F.col("m_key") == F.col("cut_key"), part).otherwise(0))
    taken = F.col("epochs") * F.col("m_size") + F.coalesce(extra, F.lit(0))
    copies = F.when(F.col("m_size") > 0, F.ceil(taken / F.col("m_size"))).otherwise(0).cast("int")
    out = (joined.withColumn("m_taken", taken).withColumn("m_copies", copies).filter("m_copies > 0")
           .withColumn("m_epoch", F.explode(F.sequence(F.lit(0), F.col("m_copies") - 1)))
           .withColumn("m_words", F.least(F.col("m_size"), F.col("m_taken") - F.col("m_epoch") * F.col("m_size"))))
    whole = F.col("row.text")
    head = F.regexp_extract_all(whole, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when(F.col("m_words") < F.col("m_size"),
                  F.array_join(F.slice(head, F.lit(1), F.col("m_words").cast("int")), "")).otherwise(whole)
    kept = {"text": text}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(F.col("m_words") < F.col("m_size"), F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[kept.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns],
                      F.col("m_epoch").alias(epoch), F.col("m_words").alias(words))


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5('1' || chr(31) || coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 12))::BIGINT AS key
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM rows GROUP BY source),
ordered AS (
  SELECT *, coalesce(sum(3.0::DOUBLE * source_size) OVER w, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open,
         sum(source_size) OVER () AS whole, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source) AS n
  FROM totals WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((whole - held) / open, n) AS per_weight FROM ordered WHERE weight * (whole - held) / open <= 3.0::DOUBLE * source_size),
targets AS (
  SELECT source, source_size, least(weight * per_weight, 3.0::DOUBLE * source_size) AS target FROM totals, level),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT r.*, b.source_size, b.target, b.epochs, round(b.target)::BIGINT - b.epochs * b.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         sum(size) OVER (PARTITION BY r.source, key) AS group_size
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN group_size = 0 THEN 0 ELSE floor(size::DOUBLE * least(greatest(rest - start, 0), group_size) / group_size) END)::BIGINT AS taken
FROM placed
"""


def mixing_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: what the registered query returns."""
    return mix_plan(spark, docs)[0].select("doc_id", "size", "source_size", "target", "taken")
