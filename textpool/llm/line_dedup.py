"""Line dedup (DataFrame functions only): per-document keep bitmaps, run-length compressed.

Hashes of line keys are range-partitioned, sorted by document and position
inside each range, and the first occurrence of every key is streamed off.
A key that very many documents share is folded per salt before that, so the
range holds at most ``SALTS`` rows of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpool.functions.arrays import explode_values
from textpool.llm.common import NO_ID, SPACES, lower_ascii, materialise

MIN_KEY = 10
SALTS = 16


def _identified(docs: DataFrame) -> DataFrame:
    """(id, version, text): rows with one id are one document; the version tells its differing texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(text).alias("version"), text.alias("text"))


def line_occurrences(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(id, version, pos, h1, h2): every line whose key is long enough, by a 128-bit hash of the key."""
    rows = _identified(docs).withColumn("lines", F.split(lower_ascii(F.col("text")), "\n", -1))
    lines = explode_values(rows, ["id", "version"], F.col("lines"), "line", "pos")
    key = F.btrim(F.col("line"), F.lit(SPACES))
    return (lines.select("id", "version", "pos", key.alias("key")).filter(F.length("key") >= min_key)
            .select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2")))


def first_occurrences(occurrences: DataFrame) -> DataFrame:
    """(h1, h2, first_id) of the keys that at least two documents hold."""
    folded = (occurrences.groupBy("h1", "h2", F.pmod("id", F.lit(SALTS)).alias("salt"))
              .agg(F.min(F.struct("id", "pos")).alias("first"), F.max("id").alias("last")))
    ranged = folded.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "first")
    whole = Window.partitionBy("h1", "h2").orderBy("first")
    streamed = ranged.select("h1", "h2", F.col("first.id").alias("first_id"), F.row_number().over(whole).alias("nth"),
                             F.max("last").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                             .alias("last_id"))
    return streamed.filter("nth = 1 AND last_id <> first_id").select("h1", "h2", "first_id")


def keep_bitmaps(spark: SparkSession, docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(id, version, dropped): sorted positions of the lines that each document loses; documents that lose none are absent."""
    occurrences = materialise(spark, line_occurrences(docs, min_key), "line-occurrences")
    lost = occurrences.join(first_occurrences(occurrences), ["h1", "h2"]).filter("id <> first_id")
    return lost.groupBy("id", "version").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """The rows of ``docs`` with ``line_dedup struct<n_lines, n_dropped, keep, kept_text>``.

    ``keep`` is the keep bitmap as runs ``(start, len)`` of kept positions;
    ``kept_text`` is the text cut by it.

    A line's key is the line stripped of white space and lower-cased in A-Z.
    Keys of ``min_key`` code points or more that two documents hold stay only
    in the smallest doc_id, there with all their lines; shorter keys always
    stay. A null text is an empty one: one empty line, kept. Rows that share a
    doc_id are one document. Rows without a doc_id are together one document
    after all others. Repeated rows get equal results. Other columns stay as
    they are. An empty table gives an empty one.
    """
    name = "line_dedup"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[
        c for c in _keys(docs)])
    dropped = keep_bitmaps(spark, docs, min_key)
    joined = rows.join(dropped, ["id", "version"], "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    cut = joined.withColumn("lines", F.split(text, "\n", -1)).withColumn(
        "cuts", F.concat(F.array(F.lit(-1)), F.coalesce("dropped", F.array().cast("array<int>")), F.array(F.size("lines"))))
    runs = F.filter(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(
        (F.get("cuts", i - 1) + 1).alias("start"), (F.get("cuts", i) - F.get("cuts", i - 1) - 1).alias("len"))),
        lambda r: r["len"] > 0)
    cut = cut.withColumn("keep", runs)
    kept = F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(F.transform(
        "keep", lambda r: F.array_join(F.slice("lines", r["start"] + 1, r["len"]), "\n")), "\n"))
    found = F.struct(F.size("lines").cast("long").alias("n_lines"),
                     F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                     F.col("keep"), kept.alias("kept_text"))
    return cut.select("row", found.alias(name))


def _keys(docs: DataFrame):
    text = F.coalesce(F.col("text"), F.lit(""))
    return (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("version"))


def line_dedup_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, keep: the digest that the registered query returns.

    ``keep`` is the compressed bitmap as text: ``start:length`` of each run of
    kept positions, comma-joined.
    """
    found = F.col("line_dedup")
    runs = F.transform(found["keep"], lambda r: F.concat(r["start"].cast("string"), F.lit(":"), r["len"].cast("string")))
    return dedup_lines(spark, docs.select("doc_id", "text")).select(
        "row.doc_id", found["n_lines"].alias("n_lines"), found["n_dropped"].alias("n_dropped"),
        F.sha2(found["kept_text"], 256).alias("kept_sha256"), F.array_join(runs, ",").alias("keep"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with its texts cut; same rows and columns (``n_chars``, if present, follows the new text)."""
    cut = dedup_lines(spark, docs)
    text = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("line_dedup.kept_text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("line_dedup.n_dropped") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
judged AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.first_id AS lost FROM keyed k LEFT JOIN firsts f USING (key)),
islands AS (
  SELECT doc_id, min(pos) AS start, count(*) AS len FROM (
    SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM judged WHERE NOT lost)
  GROUP BY doc_id, island),
bitmaps AS (SELECT doc_id, string_agg(start || ':' || len, ',' ORDER BY start) AS keep FROM islands GROUP BY doc_id),
told AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
  FROM judged GROUP BY doc_id)
SELECT t.*, coalesce(b.keep, '') AS keep FROM told t LEFT JOIN bitmaps b USING (doc_id)
"""
