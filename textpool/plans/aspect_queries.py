"""Catalogue: aspect rows, rule override, pair scoring, aspect crosstab."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpool.operators import aspects as AS
from textpool.operators import tagging as TG
from textpool.operators.scoring import PairShapeScorer, pair_logits
from textpool.plans import sql as S
from textpool.plans.registry import register
from textpool.sources.tables import read_table

PAIR_SCORER = PairShapeScorer()


def items(spark, d):
    cv = read_table(spark, d, "conversations", "conv_id", "turn", "text")
    return cv.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text")


def _rows(spark, d):
    return AS.aspect_rows(items(spark, d), PAIR_SCORER)


_BLACK = ", ".join("'" + w + "'" for w in AS.ASPECT_BLACKLIST)
_IGN = ", ".join("'" + w + "'" for w in AS.REPORT_IGNORE)
_RULE = "contains(lower(text), 'ne ') AND contains(lower(text), ' ne ')"
_ASPECT_CTES = (
    "WITH it AS (SELECT concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS id, text FROM conversations "
    "WHERE length(text) >= 2), "
    r"tk AS (SELECT id, text, list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), "
    rf"lambda t: regexp_matches(t, '^\p{{Lu}}') AND NOT list_contains([{_BLACK}], lower(t)) AND length(lower(t)) >= 3)) AS asp FROM it), "
    "ex AS (SELECT id, text, unnest(asp) AS detected_aspect FROM tk), "
    "gen AS (SELECT id, text, 'GENERAL' AS detected_aspect, 'Neutral' AS sentiment, 0.0 AS confidence_score FROM tk "
    "WHERE len(asp) = 0), "
    f"ruled AS (SELECT id, text, detected_aspect, 'Neutral' AS sentiment, 100.0 AS confidence_score FROM ex WHERE {_RULE}), "
    "lg AS (SELECT id, text, detected_aspect, CAST(0.002 AS DOUBLE) * length(text) AS l0, "
    "CAST(0.6 AS DOUBLE) * ((length(text) - length(replace(text, detected_aspect, ''))) // length(detected_aspect)) AS l1, "
    f"CAST(0.3 AS DOUBLE) * length(detected_aspect) AS l2 FROM ex WHERE NOT ({_RULE})), "
    f"sc AS ({S.scored('SELECT * FROM lg', fallback=False)}), "
    "rows AS (SELECT id, text, detected_aspect, sentiment, CAST(confidence_score AS DOUBLE) AS confidence_score FROM gen "
    "UNION ALL SELECT id, text, detected_aspect, sentiment, confidence_score FROM ruled "
    f"UNION ALL SELECT id, text, detected_aspect, {S.class_name('raw_id')}, round(confidence * 100, 2) FROM sc)\n")


@register("aspect_rows", _ASPECT_CTES + "SELECT id, detected_aspect, sentiment, confidence_score FROM rows",
          ("L1", "L2", "L4", "L5"))
def aspect_rows_q(spark, d):
    return _rows(spark, d).select("id", "detected_aspect", "sentiment", "confidence_score")


@register("aspect_rule_override", f"SELECT id, {_RULE} AS rule_neutral FROM (SELECT concat(CAST(conv_id AS VARCHAR), '-', "
          "CAST(turn AS VARCHAR)) AS id, text FROM conversations)", ("L3",))
def aspect_rule_override(spark, d):
    return items(spark, d).select("id", AS.rule_neutral(F.col("text")).alias("rule_neutral"))


@register("aspect_pair_score", _ASPECT_CTES + "SELECT id, detected_aspect, round(l0, 6) AS l0, round(l1, 6) AS l1, "
          "round(l2, 6) AS l2 FROM lg", ("L4", "M4"))
def aspect_pair_score(spark, d):
    x = items(spark, d).filter((F.length("text") >= 2) & ~AS.rule_neutral(F.col("text"))) \
        .withColumn("_asp", AS.extract_aspects(F.col("text")))
    x = x.withColumn("_lg", pair_logits(F.col("text"), F.col("_asp"), PAIR_SCORER))
    s = x.select("id", F.explode(F.arrays_zip("_asp", "_lg")).alias("_e"))
    return s.select("id", F.col("_e")["_asp"].alias("detected_aspect"),
                    *[F.round(F.col("_e")["_lg"][i], 6).alias(f"l{i}") for i in range(3)])


@register("aspect_crosstab", _ASPECT_CTES + (
    f", flt AS (SELECT * FROM rows WHERE confidence_score > 60 AND detected_aspect NOT IN ({_IGN})), "
    "top AS (SELECT detected_aspect FROM flt GROUP BY detected_aspect ORDER BY count(*) DESC, detected_aspect ASC LIMIT 10) "
    "SELECT detected_aspect, count_if(sentiment = 'Negative') AS Negative, count_if(sentiment = 'Neutral') AS Neutral, "
    "count_if(sentiment = 'Positive') AS Positive, count(*) AS Total FROM flt WHERE detected_aspect IN (SELECT * FROM top) "
    "GROUP BY detected_aspect").replace("\n, flt AS", ", flt AS"), ("A20", "A21", "P17"))
def aspect_crosstab_q(spark, d):
    return AS.aspect_crosstab(AS.report_filter(_rows(spark, d)))


@register("top_aspect_rows", _ASPECT_CTES + (
    f", flt AS (SELECT * FROM rows WHERE confidence_score > 60 AND detected_aspect NOT IN ({_IGN})), "
    "top AS (SELECT detected_aspect FROM flt GROUP BY detected_aspect ORDER BY count(*) DESC, detected_aspect ASC LIMIT 10) "
    "SELECT id, detected_aspect, sentiment, confidence_score FROM flt WHERE detected_aspect IN (SELECT * FROM top)"
).replace("\n, flt AS", ", flt AS"), ("J10", "A21", "P17"))
def top_aspect_rows_q(spark, d):
    rows = AS.report_filter(_rows(spark, d)).select("id", "detected_aspect", "sentiment", "confidence_score")
    return AS.keep_top_aspects(rows)


#: Endings of the tables' invented prose; a tagger of real text is learned (``tagging.fit_hmm``).
TAGGER = TG.SuffixTagger(("tion", "ing", "er", "ment", "ción", "eux"), ("s", "es", "ed", "er", "ers", "ing", "tion"), ("the", "and", "that", "for", "thing", "her"))
_TAGGED_SQL = (
    "WITH tk AS (SELECT concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS id, "
    r"regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+') AS t FROM conversations), "
    "ex AS (SELECT DISTINCT id, unnest(t) AS token FROM tk), "
    r"lm AS (SELECT id, token, lower(token) AS low, regexp_replace(lower(token), '^(.{3,}?)(?:tion|ers|ing|ed|er|es|s)$', '\1') AS lemma FROM ex) "
    "SELECT id, token AS detected_aspect FROM lm WHERE length(low) >= 3 "
    r"AND (regexp_matches(token, '^\p{Lu}') OR regexp_matches(low, '(tion|ing|er|ment|ción|eux)$')) "
    "AND low NOT IN ('the', 'and', 'that', 'for', 'thing', 'her') "
    f"AND low NOT IN ({_BLACK}) AND lemma NOT IN ({_BLACK})")


@register("aspect_tagged", _TAGGED_SQL, ("L1",))
def aspect_tagged(spark, d):
    """Aspects by a tagger behind the table function: nouns, stop words, lemma and surface form against the blacklist."""
    found = items(spark, d).withColumn("_tokens", TG.tag_tokens(F.col("text"), TAGGER))
    return found.select("id", F.explode(TG.aspects_of_tokens(F.col("_tokens"))).alias("detected_aspect"))
