"""Written reports, and models that outlive their fit."""

import glob

from pyspark.sql import Observation
from pyspark.sql import functions as F

from textpool.operators import features as FE
from textpool.plans import experiment_queries as EQ


def test_nested_reports_are_written_compressed_and_come_back(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(EQ, "scratch_path", lambda spark, name: str(tmp_path / name))
    df = spark.range(50).select("id", F.struct(F.lit("çok").alias("a"), F.array("id").alias("b")).alias("c"))
    back = EQ._written_json(spark, df, "reports")
    assert sorted(back.collect()) == sorted(df.collect())
    assert glob.glob(str(tmp_path / "reports" / "*.json.gz")) and not glob.glob(str(tmp_path / "reports" / "*.json"))


def test_a_fitted_model_scores_after_an_observation(spark):
    seen = Observation("seen")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    train = spark.createDataFrame([(w, y) for y, w in enumerate(["bad bad", "plain plain", "good good"]) for _ in range(4)], "text string, y int")
    assert FE.fit_text_model(train).score_frame(train).count() == 12
