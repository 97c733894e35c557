"""Record constraints as a rule table: (reason, failing-predicate) → ``reasons`` array.

Rows with an empty array are valid; the rest go to a quarantine frame. One
projection, no UDF, so it is evaluated in the same codegen stage as the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpool.functions.labels import CLASS_NAMES

# Field limits.
MAX_TEXT_CHARS = 8000
MIN_TEXT_CHARS = 1
MAX_SENTIMENT_CHARS = 64
MAX_TOPIC_CHARS = 500
MAX_BATCH_ITEMS = 500
MAX_VISUALIZE_TEXTS = 500
MAX_VISUALIZE_ROWS = 10_000

Rule = tuple[str, Column]


def text_rules(col: str = "text") -> list[Rule]:
    n = F.length(F.col(col))
    return [("text_missing", F.col(col).isNull()),
            ("text_too_short", n < MIN_TEXT_CHARS),
            ("text_too_long", n > MAX_TEXT_CHARS)]


def sentiment_rules(col: str = "sentiment") -> list[Rule]:
    n = F.length(F.col(col))
    return [("sentiment_missing", F.col(col).isNull()),
            ("sentiment_length", (n < 1) | (n > MAX_SENTIMENT_CHARS)),
            ("sentiment_unknown", ~F.col(col).isin(*CLASS_NAMES))]


def with_reasons(df: DataFrame, rules: Sequence[Rule], name: str = "reasons") -> DataFrame:
    arr = F.array(*[F.when(pred, F.lit(reason)) for reason, pred in rules])
    return df.withColumn(name, F.filter(arr, lambda x: x.isNotNull()))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    tagged = with_reasons(df, rules)
    return (tagged.filter(F.size("reasons") == 0).drop("reasons"), tagged.filter(F.size("reasons") > 0))


def request_rules() -> list[Rule]:
    """P11 + per-request caps on an aggregated request row (n_texts, n_rows, max_text_chars, title, keywords)."""
    has_t, has_r = F.col("n_texts") > 0, F.col("n_rows") > 0
    return [("exactly_one_source", has_t == has_r),
            ("too_many_texts", has_t & (F.col("n_texts") > MAX_VISUALIZE_TEXTS)),
            ("too_many_rows", has_r & (F.col("n_rows") > MAX_VISUALIZE_ROWS)),
            ("text_too_long", has_t & (F.col("max_text_chars") > MAX_TEXT_CHARS)),
            ("title_too_long", F.coalesce(F.length("topic_title"), F.lit(0)) > MAX_TOPIC_CHARS),
            ("keywords_too_long", F.coalesce(F.length("keywords_subtitle"), F.lit(0)) > MAX_TOPIC_CHARS)]
