"""Filter interaction audit: what each filter removes after every set of earlier ones.

One table of failing ids is stored per filter. The ids that survive a set of
filters come from those that survive the set without its last filter by a
left-anti join with that filter's table; what a further filter removes comes
from a left-semi join with its table. All sets of one size are rows of one
relation, so five rounds of joins answer every order. Only ids move, never
texts, and only those that fail some filter.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpool.functions.aggregates import count_where
from textpool.llm.common import NO_ID, WORD, materialise
from textpool.session import scratch_path

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
JUNK = r"[#$%&*|]"
#: Rows of equal texts are dealt over this many keys before they meet.
SALTS = 64


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that one text decides; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {"A": F.size(words) < MIN_WORDS,
            "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * MIN_DISTINCT_PERCENT,
            "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITAL_PERCENT,
            "D": text.rlike(JUNK)}


def facts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(rid, doc_id, part, digest, A..D): one row per row of ``docs``, its text read once; ``rid`` numbers the rows."""
    conditions = text_filters(F.col("text"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"), *[c.alias(f) for f, c in conditions.items()])
    return materialise(spark, rows, "audit-facts")


def later_copies(rows: DataFrame) -> DataFrame:
    """(rid) of the rows whose digest a smaller doc_id holds too; rows of one digest never meet in one task."""
    dealt = rows.select("rid", "doc_id", "digest", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).alias("salt"))
    partial = dealt.groupBy("digest", "salt").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    groups = partial.groupBy("digest").agg(F.min("first").alias("smallest"), F.max("last").alias("greatest")) \
        .filter("smallest < greatest")
    firsts = partial.join(groups, "digest").select("digest", "salt", "smallest")
    return dealt.join(firsts, ["digest", "salt"]).filter("doc_id > smallest").select("rid")


def failing_ids(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(rid, filter): the stored tables of failing ids, one folder per filter; ``filter`` is its bit."""
    path = scratch_path(spark, "audit-failing")
    for f in LETTERS:
        ids = later_copies(rows) if f == "E" else rows.filter(F.col(f)).select("rid")
        ids.write.parquet(f"{path}/filter={1 << LETTERS.index(f)}")
    return spark.read.schema("rid long, filter int").parquet(path)


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(rid, part, good, toxic): a row is good or toxic if any label row of its doc_id says so."""
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named, nameless = rows.filter(F.col("doc_id") != NO_ID), rows.filter(F.col("doc_id") == NO_ID)
    found = named.join(known, "doc_id", "left").select(
        "rid", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return found.union(nameless.select("rid", "part", F.lit(False), F.lit(False)))


def removals(spark: SparkSession, marked: DataFrame, failing: DataFrame) -> DataFrame:
    """(part, earlier, filter, removed, good_lost, toxic_lost): what ``filter`` removes of the ids that the set ``earlier`` left."""
    bits = [1 << i for i in range(len(LETTERS))]
    survivors = materialise(spark, marked.join(failing.select("rid").distinct(), "rid", "left_semi")
                            .withColumn("earlier", F.lit(0)), "audit-survivors-0")
    counts = None
    for size in range(len(LETTERS)):
        unused = F.filter(F.array(*map(F.lit, bits)), lambda b: F.col("earlier").bitwiseAND(b) == 0)
        asked = survivors.withColumn("filter", F.explode(unused))
        removed = asked.join(failing, ["rid", "filter"], "left_semi").groupBy("part", "earlier", "filter").agg(
            F.count(F.lit(1)).alias("removed"), count_where(F.col("good")).alias("good_lost"),
            count_where(F.col("toxic")).alias("toxic_lost"))
        removed = materialise(spark, removed, "audit-removed")
        counts = removed if counts is None else counts.unionByName(removed)
        if size + 1 < len(LETTERS):  # every set once: its filters join it in ascending order
            left = asked.filter(F.col("filter") > F.col("earlier")).join(failing, ["rid", "filter"], "left_anti")
            survivors = materialise(spark, left.select("rid", "part", "good", "toxic", (
                F.col("earlier") + F.col("filter")).alias("earlier")), f"audit-survivors-{size + 1}")
    return counts


def order_steps() -> list[dict]:
    """The steps of every order: 600 rows (filter_order, step, filter, earlier)."""
    steps = []
    for order in permutations(LETTERS):
        earlier = 0
        for step, f in enumerate(order, 1):
            steps.append({"filter_order": "".join(order), "step": step, "filter": 1 << LETTERS.index(f), "earlier": earlier})
            earlier += 1 << LETTERS.index(f)
    return steps


def audit_filters(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step; zeros included.

    Columns part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley, as the counts of rows of the part. Every
    row of ``docs`` counts for itself, repeated ones as well. A null text is
    empty; it fails A, and E if a smaller doc_id has no text either. Rows
    without a doc_id come after all others in E, never fail it by each other,
    and have no labels. Of several label rows of a document any may say good
    or toxic; null labels say nothing. A null source is the part of the empty
    string. Texts are read whole. Other columns are ignored. No documents give
    no rows.
    """
    rows = facts(spark, docs.select("doc_id", "text", "source"))
    failing = failing_ids(spark, rows)
    counts = removals(spark, with_labels(rows, labels.select("doc_id", "quality", "toxic")), failing)
    n = len(LETTERS)
    sets = F.bit_count("earlier")
    # orders in which exactly this set comes before the filter
    orders = F.get(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), sets)
    others = F.lit((1 << n) - 1) - F.col("filter")
    per_filter = counts.groupBy("part", "filter").agg(
        F.max(F.when(F.col("earlier") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("earlier") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders).alias("shapley"))
    schema = "array<struct<filter_order:string,step:int,filter:int,earlier:int>>"
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))
    steps = parts.select("part", "n_rows", F.inline(F.from_json(F.lit(json.dumps(order_steps())), schema)))
    found = steps.join(counts, ["part", "earlier", "filter"], "left").join(per_filter, ["part", "filter"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    found = found.select("part", "filter_order", "step", "n_rows", *[
        zero(c).alias(c) for c in ("removed", "fails", "unique_fails", "good_lost", "toxic_lost", "shapley")])
    so_far = F.aggregate("_so_far", F.lit(0).cast("long"), lambda a, x: F.when(x["step"] <= F.col("_s.step"), a + x["removed"]).otherwise(a))
    # the five steps of an order are one small row
    folded = found.groupBy("part", "filter_order", "n_rows").agg(F.collect_list(F.struct(
        "step", "removed", "fails", "unique_fails", "good_lost", "toxic_lost", "shapley")).alias("_so_far"))
    each = folded.select("part", "filter_order", "n_rows", "_so_far", F.explode("_so_far").alias("_s"))
    return each.select("part", "filter_order", F.col("_s.step").alias("step"), (F.col("n_rows") - so_far).alias("kept"),
                       F.col("_s.removed").alias("removed"), (F.col("_s.fails") - F.col("_s.removed")).alias("redundant"),
                       *[F.col(f"_s.{c}").alias(c) for c in ("unique_fails", "good_lost", "toxic_lost", "shapley")])


SQL = r"""
WITH facts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
marked AS (
  SELECT f.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
     100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(f.doc_id, 9223372036854775807) > first_id] AS fails
  FROM facts f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) l
  ON f.doc_id = l.doc_id),
classes AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
pos AS (SELECT filter_order, step, list_transform(string_split(filter_order, ''), lambda x: ascii(x) - 64) AS p FROM steps),
hits AS (
  SELECT c.part, o.filter_order, o.step, c.n, c.good, c.toxic, c.fails[o.p[o.step]] AS fails,
         coalesce(list_bool_or(list_transform(o.p[1:o.step - 1], lambda i: c.fails[i])), false) AS before,
         len(list_filter(c.fails, lambda x: x)) = 1 AS single, o.p[o.step] AS f
  FROM classes c, pos o),
counted AS (
  SELECT part, filter_order, step, any_value(f) AS f, sum(n) AS total,
    coalesce(sum(n) FILTER (fails OR before), 0) AS gone, coalesce(sum(n) FILTER (fails AND NOT before), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND before), 0) AS redundant, coalesce(sum(n) FILTER (fails AND single), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT before), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (fails AND NOT before), 0) AS toxic_lost
  FROM hits GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(total - gone AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
