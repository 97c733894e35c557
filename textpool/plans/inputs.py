"""Data roles: how the driver's tables play the reference's inputs.

Each role is a raw (uncleaned) frame; the operators then normalise it exactly
as they would a user's CSV.  The SQL twin of each role lives in ``plans/sql.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpool.functions.hashing import hex_bucket, seeded_hex
from textpool.functions.text import strip_ws
from textpool.sources.tables import read_table

SEED = 42
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
EXTRA_SAMPLE_SIZE = 10_000


def _doc_sentiment(labelled: bool = True):
    lab = (F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
           .otherwise("neutral"))
    return lab if labelled else F.when(F.col("toxic").isNull() & F.col("quality").isNull(), F.lit(None)).otherwise(lab)


def labelled_docs(spark, d: str, how: str = "inner") -> DataFrame:
    """documents ⋈ labels → (doc_id, lang, text, sentiment). ``how="left"`` keeps unlabelled docs (null label)."""
    docs = read_table(spark, d, "documents", "doc_id", "lang", "text")
    labels = read_table(spark, d, "labels", "doc_id", "quality", "toxic")
    j = docs.join(labels, "doc_id", how)
    return j.select("doc_id", "lang", "text", _doc_sentiment(how == "inner").alias("sentiment"))


def split_docs(spark, d: str) -> DataFrame:
    """All documents (labels left-joined) with their ``split`` by md5(seed || doc_id): copies cross splits."""
    b = F.col("_b")
    split = F.when(b < 8000, "train").when(b < 9000, "val").when(b >= 9000, "test")
    raw = labelled_docs(spark, d, "left")
    return raw.withColumn("_b", hex_bucket(seeded_hex(SEED, "doc_id"), 10_000)).withColumn("split", split).drop("_b")


def doc_split_frames(spark, d: str) -> dict[str, DataFrame]:
    """All documents (labels left-joined) split by md5(seed || doc_id): copies cross splits."""
    raw = labelled_docs(spark, d, "left")
    b = hex_bucket(seeded_hex(SEED, "doc_id"), 10_000)
    raw = raw.withColumn("_b", b)
    return {
        "train": raw.filter(F.col("_b") < 8000).drop("_b"),
        "val": raw.filter((F.col("_b") >= 8000) & (F.col("_b") < 9000)).drop("_b"),
        "test": raw.filter(F.col("_b") >= 9000).drop("_b"),
    }


def part_pool(spark, d: str) -> DataFrame:
    """lineitem as a large labelled pool: text = 'part <l_partkey>', label from l_returnflag."""
    li = read_table(spark, d, "lineitem", "l_partkey", "l_returnflag")
    label = (F.when(F.col("l_returnflag") == "A", F.lit("negative"))
             .when(F.col("l_returnflag") == "N", F.lit("Neutral"))
             .when(F.col("l_returnflag") == "R", F.lit(" POS ")))
    return li.select(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("tweet"), label.alias("label"))


def chat_pool(spark, d: str) -> DataFrame:
    """conversations as a raw labelled source: label from the speaker role."""
    cv = read_table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    label = (F.when(F.col("role") == "user", F.lit("neu"))
             .when(F.col("role") == "assistant", F.lit("positive"))
             .when(F.col("role") == "system", F.lit("olumsuz")))
    return cv.select(F.col("text").alias("Content"), label.alias("Sentiment"))


def hard_examples(spark, d: str) -> DataFrame:
    """Curated overrides: non-English labelled documents, ASCII upper-cased, label flipped (2 - p)."""
    ld = labelled_docs(spark, d, "inner").filter(F.col("lang") != "en")
    pol = (F.when(F.col("sentiment") == "negative", 2).when(F.col("sentiment") == "positive", 0).otherwise(1))
    upper_ascii = F.translate(F.col("text"), _LOWER, _UPPER)  # ASCII-only: engine-independent
    return ld.select(upper_ascii.alias("sentence"), pol.alias("polarity"))


def logits_table(spark, d: str) -> DataFrame:
    """embeddings as scored rows: l_i = 10 · embedding[i] (i = 1..3), truth y = label % 3."""
    e = read_table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return e.select(
        F.col("vec_id").alias("id"),
        (F.element_at("embedding", 1).cast("double") * 10).alias("l0"),
        (F.element_at("embedding", 2).cast("double") * 10).alias("l1"),
        (F.element_at("embedding", 3).cast("double") * 10).alias("l2"),
        (F.col("label") % 3).cast("int").alias("y"),
    )


def batch_entries(spark, d: str) -> DataFrame:
    """Batch items (id STRING, text STRING): conversation turns plus short event-type stubs.

    The stubs (``substring(event_type, 1, length - 4)``) give empty, 1- and
    2-character texts so the validity filter has something to reject.
    """
    cv = read_table(spark, d, "conversations", "conv_id", "turn", "text")
    ev = read_table(spark, d, "events", "event_id", "event_type")
    a = cv.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
                  F.col("text"))
    b = ev.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
                  F.concat(F.lit(" "), F.expr("substring(event_type, 1, length(event_type) - 4)")).alias("text"))
    return a.unionByName(b)


def stripped(col: str):
    return strip_ws(col)
