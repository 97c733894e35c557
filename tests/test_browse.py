from pyspark.sql import functions as F

from textpool.operators import explore as X
from textpool.operators import validation as V


def _rows(spark):
    rows = [(f"{i:03d}", t, s, c) for i, (t, s, c) in enumerate(
        [("The cat", "Neutral", 0.5), ("the dog", "Positive", 0.9), (None, "Neutral", 0.4), ("x" * 120, "Negative", -1.0)])]
    return spark.createDataFrame(rows, "id string, text string, sentiment string, confidence double")


def test_search(spark):
    df = _rows(spark)
    assert [r.id for r in X.search(df, "All", "THE").collect()] == ["000", "001"]
    assert [r.id for r in X.search(df, "Neutral", "the").collect()] == ["000"]


def test_sort_and_pages(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("k"))
    p2 = [r.id for r in X.page(df, 2, "k").collect()]
    brute = sorted(((int(i) % 7, i) for i in map(str, range(60))))[25:50]
    assert p2 == [i for _, i in brute]
    assert len(X.clamped_page(df, 99, "k").collect()) == 10  # clamped to the last page
    nulls = X.sort_rows(_rows(spark), "text", "asc").collect()
    assert nulls[0].text is None
    assert X.sort_rows(_rows(spark), "text", "desc").collect()[-1].text is None


def test_chart_frame_and_labels(spark):
    df = X.chart_frame(_rows(spark))
    assert df.count() == 3
    assert sorted((r.sentiment, r.class_index) for r in X.labels_present(df).collect()) == [("Neutral", 1), ("Positive", 2)]


def test_preview(spark):
    df = _rows(spark).withColumn("p0", F.lit(0.12345)).withColumn("p1", F.lit(0.5)).withColumn("p2", F.lit(0.37655))
    r = X.preview(df).filter(F.col("id") == "003").collect()[0]
    assert r.text_preview == "x" * 100 + "…" and r.negative_pct == "12.3%" and r.neutral_pct == "50.0%"


def test_text_limits(spark):
    df = spark.createDataFrame([(1, ""), (2, "a" * 8000), (3, "a" * 8001)], "id int, text string")
    ok, bad = V.split_valid(df, V.text_rules())
    assert [r.id for r in ok.collect()] == [2]
    assert sorted((r.id, r.reasons) for r in bad.collect()) == [(1, ["text_too_short"]), (3, ["text_too_long"])]


def test_exactly_one_source(spark):
    df = spark.createDataFrame([(1, 2, 0), (2, 0, 3), (3, 1, 1), (4, 0, 0)], "rid int, n_texts int, n_rows int") \
        .withColumn("max_text_chars", F.lit(10)).withColumn("topic_title", F.lit(None).cast("string")) \
        .withColumn("keywords_subtitle", F.lit("k"))
    ok, bad = V.split_valid(df, V.request_rules())
    assert sorted(r.rid for r in ok.collect()) == [1, 2]
    assert sorted(r.rid for r in bad.collect()) == [3, 4]


def test_sentiment_domain(spark):
    df = spark.createDataFrame([("Positive",), ("positive",), ("",)], "sentiment string")
    ok, bad = V.split_valid(df, V.sentiment_rules())
    assert [r.sentiment for r in ok.collect()] == ["Positive"]
    assert len(bad.collect()) == 2
