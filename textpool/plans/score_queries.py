"""Catalogue: scoring, fallback, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpool.functions.labels import class_name_of, polarity_of
from textpool.operators import scoring as SC
from textpool.plans import inputs as I
from textpool.plans import sql as S
from textpool.plans.registry import register

SCORER = SC.ShapeScorer()


def embed_scored(spark, d, fallback=True):
    return SC.predict_from_logits(I.logits_table(spark, d), enabled=fallback)


def doc_scored(spark, d):
    """Labelled documents scored by the reference scorer, truth carried through."""
    docs = I.labelled_docs(spark, d).select(F.col("doc_id").alias("id"), "text",
                                            polarity_of("sentiment", 1).alias("y"))
    return SC.predict_from_logits(SC.apply_scorer(SC.valid_texts(docs), SCORER))


def entries_scored(spark, d):
    return SC.score_texts(I.batch_entries(spark, d), SCORER)


EMBED_SCORED_SQL = S.scored(S.LOGITS)
DOC_SCORED_SQL = S.scored(
    f"SELECT id, text, y, {S.shape_logits('text')} FROM ("
    + S.valid_text(f"SELECT doc_id AS id, text, {S.polarity('sentiment', 1)} AS y FROM ({S.LABELLED_DOCS})") + ")")
ENTRIES_SCORED_SQL = S.scored(f"SELECT id, text, {S.shape_logits('text')} FROM ({S.valid_text(S.BATCH_ENTRIES)})")


def _pred_projection(df):
    return df.select(
        "id", class_name_of("pred_id").alias("sentiment"), class_name_of("raw_id").alias("raw_sentiment"),
        "fallback_applied", F.round("confidence", 6).alias("confidence"),
        F.round("p0", 6).alias("prob_negative"), F.round("p1", 6).alias("prob_neutral"),
        F.round("p2", 6).alias("prob_positive"))


def _pred_sql(src):
    return (f"SELECT id, {S.class_name('pred_id')} AS sentiment, {S.class_name('raw_id')} AS raw_sentiment, "
            f"fallback_applied, round(confidence, 6) AS confidence, round(p0, 6) AS prob_negative, "
            f"round(p1, 6) AS prob_neutral, round(p2, 6) AS prob_positive FROM ({src})")


@register("score_softmax_fallback", _pred_sql(EMBED_SCORED_SQL), ("M5", "M6", "M7", "P8"))
def score_softmax_fallback(spark, d):
    return _pred_projection(embed_scored(spark, d))


@register("udf_score", _pred_sql(DOC_SCORED_SQL), ("M4", "M5", "M6"))
def udf_score(spark, d):
    return _pred_projection(doc_scored(spark, d))


@register("fallback_rate", f"SELECT count(*) AS rows, count_if(fallback_applied) AS fallback_rows, "
          f"CASE WHEN count(*) > 0 THEN count_if(fallback_applied) / count(*) ELSE 0.0 END AS fallback_rate "
          f"FROM ({ENTRIES_SCORED_SQL})", ("A19",))
def fallback_rate_q(spark, d):
    return SC.fallback_rate(entries_scored(spark, d))


@register("sentiment_distribution",
          f"SELECT {S.class_name('pred_id')} AS label, count(*) AS count, false AS is_total FROM ({EMBED_SCORED_SQL}) GROUP BY 1 "
          f"UNION ALL SELECT 'Total', count(*), true FROM ({EMBED_SCORED_SQL})", ("A3", "K4"))
def sentiment_distribution_q(spark, d):
    return SC.sentiment_distribution(SC.prediction_rows(embed_scored(spark, d), with_map=False))


@register("sentiment_share",
          f"SELECT sentiment, count, round(count * 100.0 / sum(count) OVER (), 6) AS share_pct FROM ("
          f"SELECT {S.class_name('pred_id')} AS sentiment, count(*) AS count FROM ({EMBED_SCORED_SQL}) GROUP BY 1)", ("A4",))
def sentiment_share_q(spark, d):
    s = SC.sentiment_share(SC.prediction_rows(embed_scored(spark, d), with_map=False))
    return s.withColumn("share_pct", F.round("share_pct", 6))


@register("valid_text_filter", S.valid_text(S.BATCH_ENTRIES), ("P6", "P7"))
def valid_text_filter(spark, d):
    return SC.valid_texts(I.batch_entries(spark, d))


@register("distribution_sources",
          f"SELECT 'texts' AS source, {S.class_name('pred_id')} AS sentiment, count(*) AS count FROM ({ENTRIES_SCORED_SQL}) GROUP BY 2 "
          f"UNION ALL SELECT 'rows', {S.class_name(S.polarity('sentiment', 1))}, count(*) FROM ({S.LABELLED_DOCS}) GROUP BY 2",
          ("M9", "A3"))
def distribution_sources(spark, d):
    texts = SC.prediction_rows(entries_scored(spark, d), with_map=False).select(
        F.lit("texts").alias("source"), "sentiment")
    rows = I.labelled_docs(spark, d).select(F.lit("rows").alias("source"),
                                            class_name_of(polarity_of("sentiment", 1)).alias("sentiment"))
    return texts.unionByName(rows).groupBy("source", "sentiment").agg(F.count(F.lit(1)).alias("count"))
