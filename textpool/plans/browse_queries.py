"""Catalogue: validation rules, result browsing and display projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textpool.functions.aggregates import count_where
from textpool.functions.labels import class_name_of
from textpool.operators import explore as X
from textpool.operators import scoring as SC
from textpool.operators import validation as V
from textpool.operators.result_index import ResultIndex
from textpool.plans import inputs as I
from textpool.plans import sql as S
from textpool.plans.registry import register
from textpool.plans.score_queries import ENTRIES_SCORED_SQL, SCORER, entries_scored
from textpool.session import scratch_path
from textpool.sources.tables import read_table


def _pred(spark, d):
    return SC.prediction_rows(entries_scored(spark, d), with_map=False)


_PRED_SQL = (f"SELECT id, text, {S.class_name('pred_id')} AS sentiment, {S.class_name('raw_id')} AS raw_sentiment, "
             f"fallback_applied, confidence, p0, p1, p2 FROM ({ENTRIES_SCORED_SQL})")


@register("validation_rejects",
          "SELECT doc_id AS id, length(text) AS n_chars, concat_ws(',', "
          "CASE WHEN text IS NULL THEN 'text_missing' END, CASE WHEN length(text) < 1 THEN 'text_too_short' END, "
          "CASE WHEN length(text) > 8000 THEN 'text_too_long' END) AS reasons FROM documents "
          "WHERE text IS NULL OR length(text) < 1 OR length(text) > 8000", ("P9",))
def validation_rejects(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    _, bad = V.split_valid(docs, V.text_rules("text"))
    return bad.select(F.col("doc_id").alias("id"), F.length("text").alias("n_chars"),
                      F.array_join("reasons", ",").alias("reasons"))


_REQ_SQL = (
    "WITH r AS (SELECT conv_id, count_if(role = 'user') AS n_texts, count_if(role = 'system') AS n_rows, "
    "coalesce(max(CASE WHEN role = 'user' THEN length(text) END), 0) AS max_text_chars, "
    "min(CASE WHEN role = 'assistant' THEN turn END) AS first_assistant FROM conversations GROUP BY conv_id), "
    "t AS (SELECT r.*, c.text AS topic_title, CAST(NULL AS VARCHAR) AS keywords_subtitle FROM r LEFT JOIN conversations c "
    "ON c.conv_id = r.conv_id AND c.turn = r.first_assistant) "
    "SELECT conv_id, concat_ws(',', "
    "CASE WHEN (n_texts > 0) = (n_rows > 0) THEN 'exactly_one_source' END, "
    "CASE WHEN n_texts > 0 AND n_texts > 500 THEN 'too_many_texts' END, "
    "CASE WHEN n_rows > 0 AND n_rows > 10000 THEN 'too_many_rows' END, "
    "CASE WHEN n_texts > 0 AND max_text_chars > 8000 THEN 'text_too_long' END, "
    "CASE WHEN coalesce(length(topic_title), 0) > 500 THEN 'title_too_long' END, "
    "CASE WHEN coalesce(length(keywords_subtitle), 0) > 500 THEN 'keywords_too_long' END) AS reasons, "
    "n_texts, n_rows FROM t")


@register("request_rules", _REQ_SQL, ("P9", "P11"))
def request_rules_q(spark, d):
    """Each conversation as a distribution request: user turns = texts, system turns = rows,
    first assistant turn = topic title."""
    cv = read_table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    req = cv.groupBy("conv_id").agg(
        count_where(F.col("role") == "user").alias("n_texts"),
        count_where(F.col("role") == "system").alias("n_rows"),
        F.coalesce(F.max(F.when(F.col("role") == "user", F.length("text"))), F.lit(0)).alias("max_text_chars"),
        F.min_by(F.when(F.col("role") == "assistant", F.col("text")),
                 F.when(F.col("role") == "assistant", F.col("turn"))).alias("topic_title"),
    ).withColumn("keywords_subtitle", F.lit(None).cast("string"))
    tagged = V.with_reasons(req, V.request_rules())
    return tagged.select("conv_id", F.array_join("reasons", ",").alias("reasons"), "n_texts", "n_rows")


@register("sentiment_domain_rejects",
          "SELECT conv_id, turn, concat_ws(',', CASE WHEN length(s) < 1 OR length(s) > 64 THEN 'sentiment_length' END, "
          "CASE WHEN s NOT IN ('Negative', 'Neutral', 'Positive') THEN 'sentiment_unknown' END) AS reasons FROM ("
          "SELECT conv_id, turn, concat(upper(substring(role, 1, 1)), substring(role, 2)) AS s FROM conversations) "
          "WHERE length(s) < 1 OR length(s) > 64 OR s NOT IN ('Negative', 'Neutral', 'Positive')", ("P10",))
def sentiment_domain_rejects(spark, d):
    cv = read_table(spark, d, "conversations", "conv_id", "turn", "role")
    rows = cv.select("conv_id", "turn", F.concat(F.upper(F.substring("role", 1, 1)), F.substring("role", 2, 1 << 20))
                     .alias("sentiment"))
    _, bad = V.split_valid(rows, V.sentiment_rules("sentiment"))
    return bad.select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"))


@register("chart_frame", f"SELECT DISTINCT sentiment, CASE sentiment WHEN 'Negative' THEN 0 WHEN 'Neutral' THEN 1 "
          f"WHEN 'Positive' THEN 2 END AS class_index FROM ({_PRED_SQL}) WHERE confidence >= 0", ("P12", "J11"))
def chart_frame_q(spark, d):
    return X.labels_present(X.chart_frame(_pred(spark, d)))


def _valid(spark, d):
    return SC.valid_texts(I.batch_entries(spark, d))


def _scored(entries):
    """Predictions of the rows that browsing left over: only they reach the model."""
    return SC.predict_from_logits(SC.apply_scorer(entries, SCORER)).withColumn("sentiment", class_name_of("pred_id"))


@register("result_search", f"SELECT id, text, sentiment, round(confidence, 6) AS confidence FROM ({_PRED_SQL}) "
          "WHERE sentiment = 'Neutral' AND contains(lower(text), lower('The'))", ("P14",))
def result_search(spark, d):
    r = X.search(_scored(X.search(_valid(spark, d), query="The")), sentiment="Neutral")
    return r.select("id", "text", "sentiment", F.round("confidence", 6).alias("confidence"))


def _page_sql(order, where, extra=""):
    return (f"SELECT id, text, sentiment, position{extra} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS position, "
            f"greatest(1, CAST(ceil(count(*) OVER () / 25.0) AS BIGINT)) AS total_pages FROM ({_PRED_SQL})) WHERE {where}")


@register("result_page", _page_sql("text ASC NULLS FIRST, id ASC", "position > 50 AND position <= 75"), ("T2", "T3"))
def result_page(spark, d):
    rows = X.with_page_position(X.page(_valid(spark, d), 3, "text", "asc"), 3, "text", "asc")
    return _scored(rows).select("id", "text", "sentiment", "position")


@register("result_page_desc", _page_sql("text DESC NULLS LAST, id ASC", "position <= 25"), ("T2", "T3"))
def result_page_desc(spark, d):
    rows = X.with_page_position(X.page(_valid(spark, d), 1, "text", "desc"), 1, "text", "desc")
    return _scored(rows).select("id", "text", "sentiment", "position")


@register("result_page_clamped", _page_sql("text ASC NULLS FIRST, id ASC", "position > (total_pages - 1) * 25",
                                           ", total_pages AS page_no, total_pages"), ("T3",))
def result_page_clamped(spark, d):
    """A page number beyond the end gives the last page."""
    rows = X.clamped_page(_valid(spark, d), 1_000_000_000, "text", "asc")
    w = Window.partitionBy(F.lit(1)).orderBy(*X.sort_order("text", "asc"))  # one page of rows
    rows = rows.withColumn("position", F.row_number().over(w) + (F.col("page_no") - 1) * X.PAGE_SIZE)
    return _scored(rows).select("id", "text", "sentiment", "position", "page_no", "total_pages")


def _text_index(spark, d):
    return ResultIndex.write(_valid(spark, d), scratch_path(spark, "result_index"), "text")


_VALID_SQL = S.valid_text(S.BATCH_ENTRIES)


@register("result_page_keyset", (
    "SELECT id, text, position FROM (SELECT id, text, row_number() OVER (ORDER BY text ASC NULLS FIRST, id ASC) AS position, "
    f"greatest(1, count(*) OVER () // 50) AS p FROM ({_VALID_SQL})) WHERE position > (p - 1) * 25 AND position <= (p + 1) * 25"), ("T2", "T3"))
def result_page_keyset(spark, d):
    """The middle page by its number, then the page after its last row, from a clustered copy."""
    index = _text_index(spark, d)
    rows = index.files.agg(F.sum("n")).first()[0] or 0
    page_no = max(1, rows // (2 * X.PAGE_SIZE))
    first = index.page(page_no)
    last = first.orderBy(F.desc("position")).limit(1).collect()
    columns = ["id", "text", "position"]
    if not last:
        return first.select(columns)
    return first.select(columns).union(index.page_after(last[0], position=last[0]["position"]).select(columns))


@register("result_search_indexed", f"SELECT id, text FROM ({_VALID_SQL}) WHERE contains(lower(text), lower('Ation the'))", ("P14",))
def result_search_indexed(spark, d):
    return _text_index(spark, d).search("Ation the").select("id", "text")


@register("result_preview",
          f"SELECT id, CASE WHEN length(text) > 100 THEN concat(substring(text, 1, 100), '…') ELSE text END AS text_preview, "
          f"round(confidence, 4) AS confidence_4dp, printf('%.1f%%', round(p0 * 100, 1)) AS negative_pct, "
          f"printf('%.1f%%', round(p1 * 100, 1)) AS neutral_pct, printf('%.1f%%', round(p2 * 100, 1)) AS positive_pct "
          f"FROM ({ENTRIES_SCORED_SQL})", ("P15",))
def result_preview(spark, d):
    return X.preview(entries_scored(spark, d)).select("id", "text_preview", "confidence_4dp", "negative_pct",
                                                      "neutral_pct", "positive_pct")
