"""Catalogue: vocabulary/encoding, relational TF-IDF, TF-IDF + logistic regression baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpool.functions.labels import polarity_of
from textpool.functions.text import strip_ws
from textpool.operators import features as FE
from textpool.operators import metrics as M
from textpool.operators import scoring as SC
from textpool.operators import subwords as SW
from textpool.plans import inputs as I
from textpool.plans import sql as S
from textpool.plans.registry import register
from textpool.session import materialise, scratch_path
from textpool.sources.tables import read_table


def _docs(spark, d):
    return read_table(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")


_ENC_SQL = (
    r"WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents), "
    "cnt AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM d) GROUP BY token), "
    "voc AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token ASC) + 3 AS INTEGER) AS token_id FROM cnt), "
    "ex AS (SELECT id, t[i] AS token, i AS pos FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM d)), "
    "enc AS (SELECT e.id, CAST((e.pos - 1) // 158 AS INTEGER) AS window_no, list(v.token_id ORDER BY e.pos) AS ids "
    "FROM ex e JOIN voc v ON e.token = v.token GROUP BY ALL), "
    "s AS (SELECT d.id, coalesce(enc.window_no, 0) AS window_no, [2] || coalesce(enc.ids, []) || [3] AS s FROM d LEFT JOIN enc ON d.id = enc.id) "
    "SELECT id, window_no, len(s) AS n_real, array_to_string(s || list_transform(range(160 - len(s)), lambda x: 0), ' ') AS ids_text FROM s")


@register("encode_fixed", _ENC_SQL, ("M1",))
def encode_fixed_q(spark, d):
    docs = _docs(spark, d)
    enc = FE.encode_fixed(docs, FE.build_vocabulary(docs))
    return enc.select("id", "window_no", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
                      F.array_join("input_ids", " ").alias("ids_text"))


#: A public vocabulary of ranked byte merges; its ids end at 50255, so the marks follow.
SUBWORD_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SUBWORD_MARKS = {"cls_id": 50_257, "sep_id": 50_258, "pad_id": 50_259}


@register("encode_subwords", "SELECT doc_id AS id, md5(coalesce(text, '')) AS decoded_md5, true AS windows_ok FROM documents", ("M1",))
def encode_subwords_q(spark, d, vocabulary: str = SUBWORD_FILE):
    """Every text as windows of 160 sub-word ids; checked by decoding the windows' ids back into the text."""
    encoder, marks = SW.RankedMerges(vocabulary), SUBWORD_MARKS
    enc = SW.encode_subwords(_docs(spark, d), encoder, **marks)
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    # a full window before the last one, marks at both ends, padding after them
    ok = ((F.size("input_ids") == FE.MAX_LEN) & (F.col("input_ids")[0] == marks["cls_id"]) & (F.get("input_ids", real - 1) == marks["sep_id"])
          & F.forall(F.slice("input_ids", real + 1, FE.MAX_LEN), lambda x: x == marks["pad_id"]))
    whole = enc.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("window_no", F.slice("input_ids", F.lit(2), real - 2).alias("ids")))).alias("w"),
        F.bool_and(ok).alias("ok"))
    full = F.forall(F.slice("w", F.lit(1), F.size("w") - 1), lambda x: F.size(x["ids"]) == FE.MAX_LEN - 2)
    text = SW.subword_text(F.flatten(F.transform("w", lambda x: x["ids"])), encoder)
    return whole.select("id", F.md5(text).alias("decoded_md5"), (F.col("ok") & full).alias("windows_ok"))


_TFIDF_SQL = (
    r"WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents), "
    "tm AS (SELECT id, t || CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) "
    "ELSE [] END AS terms FROM d), "
    "tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM tm) GROUP BY id, term), "
    "st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term), "
    "voc AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM st WHERE df >= 2), "
    "w AS (SELECT tf.id, tf.term, tf.tf * v.idf AS w FROM tf JOIN voc v ON tf.term = v.term), "
    "nm AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY id) "
    "SELECT w.id, w.term, round(w.w / nm.nrm, 6) AS tfidf FROM w JOIN nm ON w.id = nm.id")


@register("tfidf_terms", _TFIDF_SQL, ("M2",))
def tfidf_terms(spark, d):
    return FE.tfidf_relational(_docs(spark, d)).withColumn("tfidf", F.round("tfidf", 6))


def _learning_sets(spark, d, splits=("train", "test")):
    """The splits of the labelled documents; rows without a label or without text are dropped, from all.

    A fit reads its rows several times, so documents meet their labels once and the rows are written.
    """
    rows = I.split_docs(spark, d).filter(F.col("split").isin(*splits)).select(
        F.col("doc_id").alias("id"), strip_ws("text").alias("text"), polarity_of("sentiment", None).alias("y"), "split")
    rows = materialise(spark, rows.filter(F.col("y").isNotNull() & (F.length("text") > 0)), "learning_rows")
    return [rows.filter(F.col("split") == s).drop("split") for s in splits]


@register("tfidf_logreg", None, ("M2", "M3"))
def tfidf_logreg_q(spark, d):
    """Train on the labelled documents of the train split, predict those of the test split (rows-only check: a learned model)."""
    pred = FE.tfidf_logreg(*_learning_sets(spark, d))
    return pred.select("id", "y", F.col("prediction").alias("p"))


_LEARN_SQL = (f"WITH lab AS (SELECT doc_id, b, {S.strip('text')} AS text, {S.polarity('sentiment', None)} AS y FROM ({S.ALL_DOCS})), "
              "ok AS (SELECT * FROM lab WHERE y IS NOT NULL AND length(text) > 0), "
              "mj AS (SELECT y AS m FROM ok WHERE b < 8000 GROUP BY y ORDER BY count(*) DESC, y LIMIT 1), "
              "tst AS (SELECT y, y = (SELECT m FROM mj) AS hit FROM ok WHERE b >= 9000) ")


@register("trained_comparison", _LEARN_SQL + (
    "SELECT model, CAST((SELECT count(*) FROM tst) AS BIGINT) AS rows, "
    "CAST((SELECT count(*) FROM tst WHERE y = 0) AS BIGINT) AS support_negative, "
    "CAST((SELECT count(*) FROM tst WHERE y = 1) AS BIGINT) AS support_neutral, "
    "CAST((SELECT count(*) FROM tst WHERE y = 2) AS BIGINT) AS support_positive, "
    "CAST((SELECT count(*) FROM tst) AS BIGINT) AS predicted, "
    "CASE model WHEN 'majority_class' THEN (SELECT round(avg(CAST(hit AS INTEGER)), 6) FROM tst) END AS majority_accuracy "
    "FROM (SELECT unnest(['majority_class', 'tfidf_logreg']) AS model)"), ("M3", "A7", "A16"))
def trained_comparison(spark, d):
    """The learned baseline beside the majority class, on the same test rows.

    The output is what SQL can say without the learned weights: the rows and
    their classes, that each row got a class, and the majority's accuracy.
    The learned model's quality is tested on a fixture with known answers.
    """
    train, test = _learning_sets(spark, d)
    majority = M.majority_predictions(train.select(F.col("y").alias("Polarity")), test)
    learned = FE.tfidf_logreg(train, test).select(F.lit("tfidf_logreg").alias("model"), "id", "y", F.col("prediction").alias("p"))
    counts = M.confusion_counts(majority.unionByName(learned))

    def rows(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")

    share = F.round(rows(F.col("y") == F.col("p")) / rows(F.lit(True)), 6)
    return counts.groupBy("model").agg(
        rows(F.lit(True)).alias("rows"), *[rows(F.col("y") == i).alias(f"support_{c}") for i, c in enumerate(("negative", "neutral", "positive"))],
        rows(F.col("p").between(0, 2)).alias("predicted"), F.when(F.col("model") == "majority_class", share).alias("majority_accuracy"))


@register("trained_scorer", (
    f"SELECT id, true AS probabilities_sum_to_one, true AS label_follows_policy FROM ({S.valid_text(S.BATCH_ENTRIES)})"), ("M3", "M4", "M8"))
def trained_scorer(spark, d):
    """The batch scored with the fitted, saved and reloaded model: every valid row once, each by the fallback policy."""
    path = scratch_path(spark, "text_model")
    FE.fit_text_model(_learning_sets(spark, d, ("train",))[0]).save(path)
    pred = SC.score_texts(I.batch_entries(spark, d), FE.TextModel.load(path))
    best = F.greatest("p0", "p1", "p2")
    expected = F.when(best < SC.CONFIDENCE_THRESHOLD, F.lit(1)).otherwise(F.col("raw_id"))
    return pred.select("id", (F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) < 1e-9).alias("probabilities_sum_to_one"),
                       ((F.col("pred_id") == expected) & (F.get(F.array("p0", "p1", "p2"), F.col("raw_id")) == best)).alias("label_follows_policy"))
