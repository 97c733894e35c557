"""R1 / R2 on Structured Streaming.

Neither operator is event-time based: scoring is stateless row-wise (append),
the distribution keeps state for the k class keys only (complete mode), so no
watermark is needed.  Checkpoints go under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpool.operators import scoring as SC


def score_stream(stream: DataFrame, scorer, enabled: bool = True) -> DataFrame:
    """The batch scoring plan applied to a streaming (id, text) frame."""
    return SC.prediction_rows(SC.score_texts(stream, scorer, enabled), with_map=False)


def run_score_stream(spark: SparkSession, stream: DataFrame, scorer, out_path: str, checkpoint: str) -> DataFrame:
    """Append scored rows to Parquet until the source is drained (availableNow), then read them."""
    q = (score_stream(stream, scorer).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out_path))
    q.awaitTermination()
    return spark.read.parquet(out_path)


def run_distribution_stream(spark: SparkSession, stream: DataFrame, scorer, out_path: str, checkpoint: str) -> DataFrame:
    """R2: running ``groupBy(sentiment).count()`` in complete mode; every micro-batch overwrites
    the published counts (state = 3 keys). A batch writes a folder of its own, named by its number, and the reader
    takes the last complete one, so a crash never leaves a half-written result."""
    counts = score_stream(stream, scorer).groupBy("sentiment").agg(F.count(F.lit(1)).alias("count"))

    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch:012d}")

    q = (counts.writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_counts(spark, out_path, counts.schema)


def latest_counts(spark: SparkSession, out_path: str, schema) -> DataFrame:
    """The counts of the last epoch that was written to its end; empty when no batch has run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [] if not fs.exists(path) else sorted(
        str(f.getPath()) for f in fs.listStatus(path)
        if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))
    return spark.read.schema(schema).parquet(done[-1]) if done else spark.createDataFrame([], schema)
