"""Catalogue: sources and sinks, each checked by write → read-back → compare with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpool.functions.labels import class_name_of
from textpool.operators import contract as C
from textpool.operators import pool as P
from textpool.operators import scoring as SC
from textpool.operators.ranking import with_position
from textpool.plans import inputs as I
from textpool.plans import sql as S
from textpool.plans.pool_queries import _LEAK_SQL, leakage_report_q
from textpool.plans.registry import register
from textpool.plans.score_queries import SCORER, _pred_projection, _pred_sql, EMBED_SCORED_SQL, embed_scored
from textpool.session import scratch_path
from textpool.sinks import writers as W
from textpool.sources import files as FS
from textpool.sources.tables import read_table

_CONV_ENTRIES = ("SELECT concat('c', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS id, text "
                 "FROM conversations")
_CONV_SCORED_SQL = S.scored(f"SELECT id, text, {S.shape_logits('text')} FROM ({S.valid_text(_CONV_ENTRIES)})")


def _conv_entries(spark, d):
    cv = read_table(spark, d, "conversations", "conv_id", "turn", "text")
    return cv.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
                     .alias("id"), "text")


@register("csv_roundtrip", S.contract(S.LABELLED_DOCS, "text", "sentiment", 1), ("K1", "S1", "P1"))
def csv_roundtrip(spark, d):
    path = scratch_path(spark, "csv_roundtrip")
    raw = I.labelled_docs(spark, d).select(F.col("text").alias(" Text "), F.col("sentiment").alias("Sentiment "))
    W.write_csv(raw, path)
    return C.normalise_contract(FS.read_csv(spark, path), 1)


@register("csv_quoted_breaks", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5, length(text) - length(replace(text, chr(10), '')) "
          "AS breaks, '5\" pipe' AS note FROM documents", ("S1", "K1"))
def csv_quoted_breaks(spark, d):
    """Texts with line breaks in quoted fields beside a stray quote, written and read back in pieces."""
    path = scratch_path(spark, "csv_quoted")
    docs = read_table(spark, d, "documents", "doc_id", "text")
    W.write_csv(docs.select(F.col("doc_id").alias("id"), "text", F.lit('5" pipe').alias("note")), path)
    back = FS.read_csv(spark, path, quoted_breaks=True)
    return back.select("id", F.md5("text").alias("text_md5"), F.regexp_count("text", F.lit("\n")).cast("long").alias("breaks"), "note")


def _upload_entries(spark, path):
    """(id, text) of an uploaded CSV; without an id column the id is the row's position, from 0."""
    df, _encoding, _sep = FS.read_upload_csv(spark, path)
    if C.pick_column(df.columns, C.ID_ALIASES) is None:
        df, _encoding, _sep = FS.read_upload_csv(spark, path, position="row_position")
    text_col = C.resolve_column(df.columns, C.UPLOAD_TEXT_ALIASES)
    id_col = C.pick_column(df.columns, C.ID_ALIASES) or "row_position"
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))


@register("upload_without_id", "SELECT count(*) AS n_rows, min(i) AS first_id, max(i) AS last_id, count(DISTINCT i) AS n_ids FROM "
          "(SELECT row_number() OVER () - 1 AS i FROM documents)", ("P7", "S2"))
def upload_without_id(spark, d):
    path = scratch_path(spark, "upload_no_id")
    W.write_csv(read_table(spark, d, "documents", "text").select(F.col("text").alias("Tweet"), F.lit("x").alias("note")), path, sep="\t")
    ids = _upload_entries(spark, path).select(F.col("id").cast("long").alias("i"))
    return ids.agg(F.count(F.lit(1)).alias("n_rows"), F.min("i").alias("first_id"), F.max("i").alias("last_id"),
                   F.count_distinct("i").alias("n_ids"))


@register("upload_distribution", f"SELECT {S.class_name('pred_id')} AS label, count(*) AS count FROM ({_CONV_SCORED_SQL}) GROUP BY 1 "
          f"UNION ALL SELECT 'Total', count(*) FROM ({_CONV_SCORED_SQL})", ("M8", "A3"))
def upload_distribution(spark, d):
    return SC.score_upload(_conv_entries(spark, d), SCORER)["distribution"].select("label", "count")


@register("upload_fallback", "SELECT count(*) AS rows, count(*) FILTER (fallback_applied) AS fallback_rows, "
          f"CASE WHEN count(*) > 0 THEN round(count(*) FILTER (fallback_applied) / count(*), 6) ELSE 0 END AS fallback_rate FROM ({_CONV_SCORED_SQL})",
          ("M8", "A19"))
def upload_fallback(spark, d):
    return SC.score_upload(_conv_entries(spark, d), SCORER)["fallback"].withColumn("fallback_rate", F.round("fallback_rate", 6))


@register("upload_pipeline", f"SELECT id, {S.class_name('pred_id')} AS sentiment, {S.class_name('raw_id')} AS raw_sentiment, "
          f"fallback_applied, round(confidence, 4) AS confidence FROM ({_CONV_SCORED_SQL})", ("M8", "S2", "P1", "P7"))
def upload_pipeline(spark, d):
    path = scratch_path(spark, "upload")
    W.write_csv(_conv_entries(spark, d).select(F.col("id").alias("row_id"), F.col("text").alias("Message")), path, sep=";")
    pred = SC.score_upload(_upload_entries(spark, path), SCORER)["predictions"]  # scored once; distribution/fallback read the same rows
    return pred.select("id", "sentiment", "raw_sentiment", "fallback_applied", F.round("confidence", 4).alias("confidence"))


@register("encoding_csv", "SELECT doc_id AS id, length(text) AS n_chars, 'ISO-8859-1' AS encoding FROM documents",
          ("S3",))
def encoding_csv(spark, d):
    path = scratch_path(spark, "latin1")
    docs = read_table(spark, d, "documents", "doc_id", "text")
    W.write_csv(docs.select(F.col("doc_id").alias("id"), "text"), path, encoding="ISO-8859-1")
    df, enc, _sep = FS.read_upload_csv(spark, path)
    return df.select(F.col("id").cast("long").alias("id"), F.length("text").alias("n_chars"), F.lit(enc).alias("encoding"))


@register("json_report_roundtrip", _LEAK_SQL, ("K2",))
def json_report_roundtrip(spark, d):
    rep = leakage_report_q(spark, d)
    path = scratch_path(spark, "leakage_json")
    W.write_json_report(rep, path)
    back = spark.read.schema(rep.schema).json(path)
    return back


@register("run_partitioned", _pred_sql(EMBED_SCORED_SQL), ("K5",))
def run_partitioned(spark, d):
    root = scratch_path(spark, "runs")
    W.write_run(_pred_projection(embed_scored(spark, d, True)), root, "fallback_on")
    W.write_run(_pred_projection(embed_scored(spark, d, False)), root, "fallback_off")
    back = spark.read.parquet(root).filter(F.col("run_name") == "fallback_on")  # partition pruning
    return back.drop("run_name")


@register("line_items", (
    "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_id, kept[i] AS line FROM (SELECT doc_id, kept, "
    "unnest(range(1, len(kept) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, "
    f"'\\r?\\n'), lambda s: {S.strip('s')}), lambda s: length(s) >= 2) AS kept FROM documents))"), ("S6",))
def line_items(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    return FS.lines_to_items(docs, "text").select("doc_id", "line_id", "line")


@register("source_sample", S.contract(S.seeded_sample(S.CHAT_POOL, 300, "Content", "Sentiment"), "Content", "Sentiment", 1),
          ("S4", "S5", "W5"))
def source_sample(spark, d):
    """Raw rows are sampled, then normalised, so rows that the contract drops count towards the 300."""
    return C.normalise_contract(P.seeded_sample(I.chat_pool(spark, d), 300, I.SEED, ("Content", "Sentiment")), 1)


@register("source_profile", "SELECT Polarity, count(*) AS count FROM ({})".format(
    S.contract(S.CHAT_POOL, "Content", "Sentiment", 1)) + " GROUP BY Polarity", ("S5", "A2"))
def source_profile(spark, d):
    return P.label_distribution(C.normalise_contract(I.chat_pool(spark, d), 1))


_RAW_LABEL = f"CASE {S.polarity('Sentiment', None)} WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' ELSE 'unlabelled' END"


@register("source_landing", f"SELECT 'Content,Sentiment' AS columns, label, n AS count, CAST(sum(n) OVER () AS BIGINT) AS rows FROM "
          f"(SELECT l.label, count(c.lb) AS n FROM (SELECT unnest(['negative', 'neutral', 'positive', 'unlabelled']) AS label) l "
          f"LEFT JOIN (SELECT {_RAW_LABEL} AS lb FROM ({S.CHAT_POOL})) c ON c.lb = l.label GROUP BY l.label)", ("S5", "K1"))
def source_landing(spark, d):
    """The raw source is landed as CSV; its columns, rows and label counts come from the pass that writes it."""
    found = P.land_source(I.chat_pool(spark, d), scratch_path(spark, "landing"), "Sentiment")
    return spark.createDataFrame([(",".join(found["columns"]), k, n, found["rows"]) for k, n in found["labels"].items()],
                                 "columns string, label string, count long, rows long")


@register("optional_source", S.contract(S.LABELLED_DOCS, "text", "sentiment", 1), ("S8", "J1"))
def optional_source(spark, d):
    base = C.normalise_contract(I.labelled_docs(spark, d), 1)
    missing = FS.optional_contract_source(spark, scratch_path(spark, "absent") + "/hard.csv",
                                          lambda s, p: C.normalise_contract(FS.read_csv(s, p), 1))
    return P.union_pools(base, missing)


@register("results_export", (
    f"SELECT id AS ID, text AS Text, {S.class_name('pred_id')} AS Sentiment, round(confidence, 4) AS Confidence, "
    f"'Campaign feedback' AS topic_title, 'delivery, returns' AS keywords_subtitle FROM ({_CONV_SCORED_SQL})"),
    ("K3", "P13"))
def results_export(spark, d):
    path = scratch_path(spark, "results_csv")
    pred = SC.prediction_rows(SC.score_texts(_conv_entries(spark, d), SCORER), with_map=False)
    W.results_export(pred, path, "  Campaign feedback ", "delivery, returns\t")
    back = FS.read_csv(spark, path)
    return back.select("ID", "Text", "Sentiment", F.col("Confidence").cast("double").alias("Confidence"),
                       F.coalesce("topic_title", F.lit("")).alias("topic_title"),
                       F.coalesce("keywords_subtitle", F.lit("")).alias("keywords_subtitle"))


@register("stats_export_total", (
    f"SELECT {S.class_name('pred_id')} AS Label, count(*) AS Count FROM ({EMBED_SCORED_SQL}) GROUP BY 1 "
    f"UNION ALL SELECT 'Total', count(*) FROM ({EMBED_SCORED_SQL})"), ("K4", "A3"))
def stats_export_total(spark, d):
    path = scratch_path(spark, "stats_csv")
    dist = SC.sentiment_distribution(SC.prediction_rows(embed_scored(spark, d), with_map=False))
    W.stats_export(dist, path)
    back = FS.read_csv(spark, path)
    return back.select("Label", F.col("Count").cast("long").alias("Count"))


@register("row_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents", ("W1",))
def row_index(spark, d):
    return with_position(read_table(spark, d, "documents", "doc_id")).select("doc_id", "position")


@register("label_names", f"SELECT Polarity, {S.class_name('Polarity')} AS class_name, count(*) AS count FROM ("
          + S.contract(S.ALL_DOCS, "text", "sentiment", 1) + ") GROUP BY Polarity", ("P8",))
def label_names(spark, d):
    c = C.normalise_contract(I.labelled_docs(spark, d, "left"), 1)
    return c.groupBy("Polarity").agg(F.count(F.lit(1)).alias("count")).withColumn("class_name", class_name_of("Polarity"))
