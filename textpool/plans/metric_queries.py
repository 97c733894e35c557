"""Catalogue: evaluation metrics over one long (model, id, y, p) table."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpool.operators import metrics as M
from textpool.operators import pool as P
from textpool.plans import inputs as I
from textpool.plans import sql as S
from textpool.plans.registry import register
from textpool.plans.pool_queries import _SPLIT_CTE
from textpool.plans.score_queries import DOC_SCORED_SQL, EMBED_SCORED_SQL, doc_scored, embed_scored

_EVAL_COLS = ["model", "id", "y", "p", "sentence", "p0", "p1", "p2"]


def evals(spark, d):
    """Long prediction table: embeddings argmax / with fallback, majority class, text scorer."""
    e_on = embed_scored(spark, d, True)
    e_off = embed_scored(spark, d, False)
    nul = F.lit(None).cast("string").alias("sentence")
    a = e_off.select(F.lit("embed_argmax").alias("model"), "id", "y", F.col("pred_id").alias("p"), nul, "p0", "p1", "p2")
    b = e_on.select(F.lit("embed_fallback").alias("model"), "id", "y", F.col("pred_id").alias("p"), nul, "p0", "p1", "p2")
    logits = I.logits_table(spark, d)
    maj = M.majority_predictions(logits.select(F.col("y").alias("Polarity")), logits).select(
        "model", "id", "y", "p", nul, *[F.lit(None).cast("double").alias(c) for c in ("p0", "p1", "p2")])
    t = doc_scored(spark, d).select(F.lit("text_scorer").alias("model"), "id", "y", F.col("pred_id").alias("p"),
                                    F.col("text").alias("sentence"), "p0", "p1", "p2")
    return a.unionByName(b).unionByName(maj).unionByName(t)


EVALS_SQL = (
    f"WITH es AS ({S.scored(S.LOGITS, fallback=True)}), en AS ({S.scored(S.LOGITS, fallback=False)}), "
    f"ds AS ({DOC_SCORED_SQL}), lg AS ({S.LOGITS}), "
    "mj AS (SELECT y AS m FROM (SELECT y, count(*) AS n FROM lg GROUP BY y) ORDER BY n DESC, y ASC LIMIT 1), "
    "ev AS ("
    "SELECT 'embed_argmax' AS model, id, y, pred_id AS p, CAST(NULL AS VARCHAR) AS sentence, p0, p1, p2 FROM en "
    "UNION ALL SELECT 'embed_fallback', id, y, pred_id, NULL, p0, p1, p2 FROM es "
    "UNION ALL SELECT 'majority_class', id, y, (SELECT m FROM mj), NULL, NULL, NULL, NULL FROM lg "
    "UNION ALL SELECT 'text_scorer', id, y, pred_id, text, p0, p1, p2 FROM ds), "
    "conf AS (SELECT model, y, p, count(*) AS n FROM ev GROUP BY model, y, p), "
    "pc AS (SELECT model, c, sum(CASE WHEN y = c AND p = c THEN n ELSE 0 END) AS tp, "
    "sum(CASE WHEN y = c THEN n ELSE 0 END) AS support, sum(CASE WHEN p = c THEN n ELSE 0 END) AS predicted "
    "FROM conf, (SELECT unnest([0, 1, 2]) AS c) GROUP BY model, c), "
    "r1 AS (SELECT model, c, support, predicted, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS prec, "
    "CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rec FROM pc), "
    "rep AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM r1), "
    "avgs AS (SELECT model, avg(CASE WHEN support > 0 OR predicted > 0 THEN prec END) AS macro_precision, "
    "avg(CASE WHEN support > 0 OR predicted > 0 THEN rec END) AS macro_recall, "
    "avg(CASE WHEN support > 0 OR predicted > 0 THEN f1 END) AS macro_f1, "
    "sum(prec * support) / sum(support) AS weighted_precision, sum(rec * support) / sum(support) AS weighted_recall, "
    "sum(f1 * support) / sum(support) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support FROM rep GROUP BY model), "
    "acc AS (SELECT model, sum(CASE WHEN y = p THEN n ELSE 0 END) / sum(n) AS accuracy, CAST(sum(n) AS BIGINT) AS rows "
    "FROM conf GROUP BY model)\n"
)


def _r(df, cols):
    return M.round_cols(df, cols)


@register("accuracy", EVALS_SQL + "SELECT model, round(accuracy, 6) AS accuracy, rows FROM acc", ("A8",))
def accuracy_q(spark, d):
    return _r(M.accuracy(evals(spark, d)), ["accuracy"])


@register("class_report", EVALS_SQL + f"SELECT model, {S.class_name('c')} AS class, round(prec, 6) AS precision, "
          "round(rec, 6) AS recall, round(f1, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM rep", ("A9",))
def class_report_q(spark, d):
    r = M.class_report(evals(spark, d)).select("model", "class", "precision", "recall", "f1_score", "support")
    return _r(r, ["precision", "recall", "f1_score"])


_AVG = ["macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]


@register("report_averages", EVALS_SQL + "SELECT model, " + ", ".join(f"round({c}, 6) AS {c}" for c in _AVG)
          + ", support FROM avgs", ("A10", "A11"))
def report_averages_q(spark, d):
    return _r(M.report_averages(evals(spark, d)), _AVG)


@register("model_comparison", EVALS_SQL + "SELECT a.model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 "
          "FROM acc a JOIN avgs v ON a.model = v.model", ("A16", "T1"))
def model_comparison_q(spark, d):
    return M.model_comparison(evals(spark, d))


@register("confusion_matrix", EVALS_SQL + f"SELECT model, {S.class_name('t')} AS true_label, "
          "CAST(sum(CASE WHEN y = t AND p = 0 THEN n ELSE 0 END) AS BIGINT) AS Negative, "
          "CAST(sum(CASE WHEN y = t AND p = 1 THEN n ELSE 0 END) AS BIGINT) AS Neutral, "
          "CAST(sum(CASE WHEN y = t AND p = 2 THEN n ELSE 0 END) AS BIGINT) AS Positive "
          "FROM conf, (SELECT unnest([0, 1, 2]) AS t) GROUP BY model, t", ("A12",))
def confusion_matrix_q(spark, d):
    return M.confusion_matrix(evals(spark, d))


@register("misclassified", EVALS_SQL + f"SELECT id AS row_id, sentence, {S.class_name('y')} AS true_label, "
          f"{S.class_name('p')} AS pred_label FROM ev WHERE model = 'text_scorer' AND y <> p", ("A13", "P8", "J7"))
def misclassified_q(spark, d):
    return M.misclassified(evals(spark, d).filter(F.col("model") == "text_scorer"))


@register("confusion_pairs", EVALS_SQL + f"SELECT model, {S.class_name('y')} AS true_label, {S.class_name('p')} AS pred_label, "
          "n AS count FROM conf WHERE y <> p", ("A14",))
def confusion_pairs_q(spark, d):
    return M.confusion_pairs(evals(spark, d))


_ES = ["error_rate", "correct_rate_negative", "correct_rate_neutral", "correct_rate_positive"]


@register("error_summary", EVALS_SQL + (
    "SELECT model, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN y <> p THEN n ELSE 0 END) AS BIGINT) AS errors, "
    "round(sum(CASE WHEN y <> p THEN n ELSE 0 END) / sum(n), 6) AS error_rate, "
    + ", ".join(f"round(coalesce(sum(CASE WHEN y = {c} AND p = {c} THEN n ELSE 0 END) / nullif(sum(CASE WHEN y = {c} THEN n ELSE 0 END), 0), 0.0), 6) AS correct_rate_{nm}"
                for c, nm in [(0, "negative"), (1, "neutral"), (2, "positive")])
    + ", CAST(sum(CASE WHEN least(y, p) = 0 AND greatest(y, p) = 2 THEN n ELSE 0 END) AS BIGINT) AS polarity_flips"
    ", CAST(sum(CASE WHEN least(y, p) = 0 AND greatest(y, p) = 1 THEN n ELSE 0 END) AS BIGINT) AS cluster_negative_neutral"
    ", CAST(sum(CASE WHEN least(y, p) = 1 AND greatest(y, p) = 2 THEN n ELSE 0 END) AS BIGINT) AS cluster_neutral_positive"
    " FROM conf GROUP BY model"), ("A15",))
def error_summary_q(spark, d):
    return _r(M.error_summary(evals(spark, d)), _ES)


@register("weighted_cross_entropy", EVALS_SQL + (
    ", w0 AS (SELECT c.c AS y, coalesce(k.n, 0) AS n, sum(coalesce(k.n, 0)) OVER () AS tot FROM (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS c) c "
    "LEFT JOIN (SELECT y, count(*) AS n FROM ev WHERE model = 'embed_argmax' GROUP BY y) k ON c.c = k.y), "
    "w1 AS (SELECT y, CASE WHEN tot = 0 THEN 1.0 ELSE tot / (3.0 * greatest(n, 1)) END AS w FROM w0), "
    "w2 AS (SELECT y, w / avg(w) OVER () AS w FROM w1), wt AS (SELECT y, w / avg(w) OVER () AS weight FROM w2) "
    "SELECT model, round(sum(weight * -ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) / sum(weight), 6) AS weighted_ce, "
    "round(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS mean_ce "
    "FROM ev JOIN wt USING (y) WHERE p0 IS NOT NULL GROUP BY model").replace("\nSELECT model, round(sum(weight", " SELECT model, round(sum(weight"),
    ("A18", "A6"))
def weighted_cross_entropy_q(spark, d):
    ev = evals(spark, d)
    w = P.class_weights(ev.filter(F.col("model") == "embed_argmax").select(F.col("y").alias("Polarity")))
    scored = ev.filter(F.col("p0").isNotNull())
    return _r(M.weighted_cross_entropy(scored, w), ["weighted_ce", "mean_ce"])


# ── A7: majority baseline on the stratified lineitem split ──────────────────
@register("majority_baseline", (
    "WITH sp AS ({split}), "
    "mj AS (SELECT Polarity AS m FROM (SELECT Polarity, count(*) AS n FROM sp WHERE split = 'train' GROUP BY Polarity) "
    "ORDER BY n DESC, Polarity ASC LIMIT 1) "
    "SELECT 'majority_class' AS model, CAST(count(*) AS BIGINT) AS rows, "
    "round(avg(CASE WHEN Polarity = (SELECT m FROM mj) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, "
    "(SELECT m FROM mj) AS majority_label FROM sp WHERE split = 'test'").format(
        pool="SELECT 1", split=_SPLIT_CTE + "SELECT * FROM s"), ("A7",))
def majority_baseline(spark, d):
    from textpool.plans.pool_queries import _split_pool
    sp = _split_pool(spark, d)
    train = sp.filter(F.col("split") == "train").select("Polarity")
    test = sp.filter(F.col("split") == "test").select(F.col("Sentence").alias("id"), F.col("Polarity").alias("y"))
    pred = M.majority_predictions(train, test)
    return pred.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg((F.col("y") == F.col("p")).cast("double")), 6).alias("accuracy"),
        F.first("p").alias("majority_label"))
