import os
import tempfile

from pyspark.sql import functions as F

from textpool.operators import scoring as SC
from textpool.streaming import stream as ST


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="textpool-stream-")
    src = os.path.join(d, "in")
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(["a, b", "hello there", "x", "one\ntwo, three"] * 5)],
                               "id string, text string")
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = ST.run_score_stream(spark, stream, SC.ShapeScorer(), os.path.join(d, "out"), os.path.join(d, "ck"))
    batch = SC.prediction_rows(SC.score_texts(df, SC.ShapeScorer()), with_map=False)
    key = ["id", "sentiment", "raw_sentiment", "fallback_applied"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))
    stream2 = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    dist = ST.run_distribution_stream(spark, stream2, SC.ShapeScorer(), os.path.join(d, "dist"), os.path.join(d, "ck2"))
    exp = {r.sentiment: r["count"] for r in batch.groupBy("sentiment").count().collect()}
    assert {r.sentiment: r["count"] for r in dist.collect()} == exp
    assert F is not None
