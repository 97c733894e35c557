"""Catalogue: streaming scoring and running distribution (checked as stream == batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpool.plans import sql as S
from textpool.plans.io_queries import _CONV_SCORED_SQL
from textpool.plans.registry import register
from textpool.plans.score_queries import SCORER
from textpool.session import scratch_path
from textpool.sources.tables import table_path, table_is_folder
from textpool.streaming import stream as ST


def _conv_stream(spark, d):
    schema = spark.read.parquet(table_path(d, "conversations")).schema
    # the file source watches a directory; the glob picks this table's files
    folder = table_path(d, "conversations")
    src = (spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if table_is_folder(spark, folder) else "conversations.parquet")
           .parquet(folder if table_is_folder(spark, folder) else d))
    return src.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
                      .alias("id"), "text")


@register("stream_score", f"SELECT id, {S.class_name('pred_id')} AS sentiment, {S.class_name('raw_id')} AS raw_sentiment, "
          f"fallback_applied, round(confidence, 6) AS confidence FROM ({_CONV_SCORED_SQL})", ("R1",))
def stream_score(spark, d):
    out = scratch_path(spark, "stream_out")
    res = ST.run_score_stream(spark, _conv_stream(spark, d), SCORER, out, out + "_ckpt")
    return res.select("id", "sentiment", "raw_sentiment", "fallback_applied", F.round("confidence", 6).alias("confidence"))


@register("stream_distribution", f"SELECT {S.class_name('pred_id')} AS sentiment, count(*) AS count FROM ({_CONV_SCORED_SQL}) "
          "GROUP BY 1", ("R2",))
def stream_distribution(spark, d):
    out = scratch_path(spark, "stream_dist")
    return ST.run_distribution_stream(spark, _conv_stream(spark, d), SCORER, out, out + "_ckpt")
