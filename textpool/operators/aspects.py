"""Aspect-level analytics (the reference's archived aspect pipeline), on DataFrames.

Extraction is a Column expression over the token array (``filter`` +
``array_distinct``); the part-of-speech test is a pluggable Column predicate
(default: capitalised token, a proper-noun heuristic).  Scoring uses the same
Arrow scorer path as sentences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpool.functions.aggregates import count_where
from textpool.functions.labels import class_name_of
from textpool.functions.scoring import argmax3, softmax3
from textpool.operators.scoring import pair_logits

# The aspect blacklist (checked against the lower-cased token).
ASPECT_BLACKLIST = [
    "ben", "sen", "o", "biz", "siz", "onlar", "bu", "şu", "kim", "ne", "biri", "birisi",
    "ve", "ile", "ama", "fakat", "lakin", "veya", "hem", "hemde", "da", "de", "ki",
    "gibi", "kadar", "diye", "için", "üzere", "yüzden", "nedeniyle", "dolayı",
    "bence", "zaten", "artık", "bile", "sadece", "daha", "çok", "az", "en", "pek",
    "gün", "zaman", "saat", "yıl", "hafta", "bugün", "yarın", "dün", "sonra", "önce",
    "şey", "konu", "taraf", "kısım", "bölüm", "yer", "kez", "kere", "sefer",
    "lazım", "gerek", "var", "yok", "tane", "adet",
    "iyi", "kötü", "güzel", "çirkin", "fena", "berbat", "harika", "muhteşem",
    "büyük", "küçük", "uzun", "kısa", "eski", "yeni", "zor", "kolay", "bozuk", "sağlam",
]
# Aspects ignored by the report, and its confidence cut.
REPORT_IGNORE = ["nin", "un", "in", "yi", "yı", "su", "bu", "o", "bir", "sahibi", "bakanı", "GENEL", "tane"]
REPORT_MIN_CONFIDENCE = 60
GENERAL = "GENERAL"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
MIN_ASPECT_CHARS = 3

NounTest = Callable[[Column], Column]


def capitalised(tok: Column) -> Column:
    return tok.rlike(r"^\p{Lu}")


def extract_aspects(text: Column, noun_test: NounTest = capitalised) -> Column:
    """L1: distinct noun-like tokens, not blacklisted, at least 3 characters (lower-cased)."""
    toks = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)
    # cheapest test first; the blacklist IN-list becomes a hash-set lookup (InSet)
    keep = lambda t: (F.length(F.lower(t)) >= MIN_ASPECT_CHARS) & noun_test(t) & ~F.lower(t).isin(*ASPECT_BLACKLIST)
    return F.array_distinct(F.filter(toks, keep))


def rule_neutral(text: Column) -> Column:
    """L3: texts containing 'ne ' and ' ne ' (lower-cased) are Neutral with confidence 1.0."""
    low = F.lower(text)
    return F.contains(low, F.lit("ne ")) & F.contains(low, F.lit(" ne "))


def aspect_rows(items: DataFrame, pair_scorer, noun_test: NounTest = capitalised, aspects: Column | None = None) -> DataFrame:
    """L1 + L2 + L3 + L4 + L5: one row per (text, aspect); no aspect → GENERAL / Neutral / 0.0.

    Input ``(id, text)``; texts shorter than 2 characters are skipped.  One
    pass: aspects are extracted once, the model gets a text with the list of
    its aspects (an empty list where the neutral rule decides), and the rows
    are exploded after that, so a text travels to Python once. ``aspects``:
    the aspects of a text by another rule, as those of a tagger's tokens
    (``tagging.aspects_of_tokens``).
    """
    found = extract_aspects(F.col("text"), noun_test) if aspects is None else aspects
    x = items.filter(F.length("text") >= 2).withColumn("_asp", found) \
        .withColumn("_rule", rule_neutral(F.col("text")))
    asked = F.when(F.col("_rule"), F.array().cast("array<string>")).otherwise(F.col("_asp"))
    scored = x.withColumn("_lg", pair_logits(F.col("text"), asked, pair_scorer))
    ex = scored.select("id", "text", "_rule", F.explode_outer(F.arrays_zip("_asp", "_lg")).alias("_e"))
    lg = [F.col("_e")["_lg"][i] for i in range(3)]
    s = ex.select("id", "text", "_rule", F.col("_e")["_asp"].alias("detected_aspect"),
                  *(c.alias(f"p{i}") for i, c in enumerate(softmax3(*lg))))
    none = F.col("detected_aspect").isNull()
    model_label = class_name_of(argmax3(F.col("p0"), F.col("p1"), F.col("p2")))
    return s.select(
        "id", "text",
        F.coalesce(F.col("detected_aspect"), F.lit(GENERAL)).alias("detected_aspect"),
        F.when(none | F.col("_rule"), F.lit("Neutral")).otherwise(model_label).alias("sentiment"),
        F.when(none, F.lit(0.0)).when(F.col("_rule"), F.lit(100.0))
        .otherwise(F.round(F.greatest("p0", "p1", "p2") * 100, 2)).alias("confidence_score"),
    )


def report_filter(rows: DataFrame) -> DataFrame:
    """Rename legacy columns, keep confidence > 60, drop ignored aspects."""
    r = rows
    if "conf" in r.columns:
        r = r.withColumnRenamed("conf", "confidence_score")
    if "aspect" in r.columns:
        r = r.withColumnRenamed("aspect", "detected_aspect")
    if "confidence_score" in r.columns:
        r = r.filter(F.col("confidence_score") > REPORT_MIN_CONFIDENCE)
    return r.filter(~F.col("detected_aspect").isin(*REPORT_IGNORE))


def top_aspects(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent aspects (count desc, aspect asc) — a bounded top-k."""
    return rows.groupBy("detected_aspect").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), F.asc("detected_aspect")).limit(k)


def keep_top_aspects(rows: DataFrame, k: int = 10, materialise: bool = True) -> DataFrame:
    """The rows whose aspect is among the top-k (a ≤ k-row table, so the semi join broadcasts it).

    The rows are read twice (ranking, then the semi join); with ``materialise``
    they are written once with a reliable ``checkpoint()`` in the shared folder,
    so the scorer behind them runs once.
    """
    if materialise:
        from textpool.session import checkpoint_root
        checkpoint_root(rows.sparkSession)
        rows = rows.checkpoint(eager=True)
    top = top_aspects(rows, k).select("detected_aspect")
    return rows.join(F.broadcast(top), "detected_aspect", "left_semi")


def aspect_crosstab(rows: DataFrame, k: int = 10) -> DataFrame:
    """A20 + A21: aspect × sentiment counts with ``Total`` for the top-k aspects, Total descending.

    One partially aggregated pass: per-aspect sentiment counts and the total
    come from the same ``groupBy``, and the top-k by Total (= the aspect's row
    count, the A21 ranking) is a bounded TakeOrderedAndProject over that
    aggregate — the rows are read once, not once for the ranking and again
    for a semi join.
    """
    ct = rows.groupBy("detected_aspect").agg(
        *[count_where(F.col("sentiment") == s).alias(s) for s in ("Negative", "Neutral", "Positive")],
        F.count(F.lit(1)).alias("Total"))
    return ct.orderBy(F.desc("Total"), F.asc("detected_aspect")).limit(k)
