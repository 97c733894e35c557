import pandas as pd
import pytest
from pyspark.sql import functions as F

from textpool.operators import scoring as SC


def _logits(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, l0 double, l1 double, l2 double")


def _classes(df):
    return [r.pred_id for r in df.orderBy("id").collect()]


def test_fallback_off(spark):
    assert _classes(SC.predict_from_logits(_logits(spark, [(0.1, 0.2, 0.9)]), enabled=False)) == [2]


def test_fallback_threshold_high(spark):
    assert _classes(SC.predict_from_logits(_logits(spark, [(0.3, 0.3, 0.4)]), threshold=0.99)) == [1]


def test_fallback_threshold_low(spark):
    assert _classes(SC.predict_from_logits(_logits(spark, [(0.0, 0.0, 5.0)]), threshold=0.5)) == [2]


def test_mixed_batch(spark):
    assert _classes(SC.predict_from_logits(_logits(spark, [(0, 0, 10), (0.3, 0.3, 0.4)]), threshold=0.99)) == [2, 1]


def test_cardinality_and_probabilities(spark):
    import random
    rnd = random.Random(1)
    rows = [tuple(rnd.uniform(-5, 5) for _ in range(3)) for _ in range(16)]
    out = SC.predict_from_logits(_logits(spark, rows)).collect()
    assert len(out) == 16
    for r in out:
        assert abs(r.p0 + r.p1 + r.p2 - 1) < 1e-12
        assert r.confidence == max(r.p0, r.p1, r.p2)


def test_flag_semantics(spark):
    # low confidence but already neutral → not flagged; low-confidence positive → flagged
    out = SC.predict_from_logits(_logits(spark, [(0.0, 0.2, 0.1), (0.0, 0.1, 0.2)])).orderBy("id").collect()
    assert [(r.raw_id, r.pred_id, r.fallback_applied) for r in out] == [(1, 1, False), (2, 1, True)]
    assert out[1].confidence < 0.7


def test_unknown_fallback_label(spark):
    with pytest.raises(ValueError):
        SC.predict_from_logits(_logits(spark, [(0, 0, 1)]), fallback_label="Mixed")


def test_argmax_first_wins_on_ties(spark):
    assert _classes(SC.predict_from_logits(_logits(spark, [(1, 1, 1), (0, 2, 2)]), enabled=False)) == [0, 1]


def test_scorer_udf_matches_pandas(spark):
    texts = ["a, b, c", "one\ntwo", "x" * 300, "hello"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = SC.apply_scorer(df, SC.ShapeScorer()).orderBy("id").toPandas()
    ref = SC.ShapeScorer()()(pd.Series(texts))
    assert (got[["l0", "l1", "l2"]].values == ref.values).all()


def test_valid_text_filter_and_projection(spark):
    df = spark.createDataFrame([("1", " ok "), ("2", " x "), ("3", None), ("4", "　ab　")], "id string, text string")
    v = SC.valid_texts(df).collect()
    assert [(r.id, r.text) for r in v] == [("1", "ok"), ("4", "ab")]
    pred = SC.prediction_rows(SC.score_texts(df, SC.ShapeScorer())).collect()
    assert {r.id for r in pred} == {"1", "4"}
    assert set(pred[0].probabilities.keys()) == {"Negative", "Neutral", "Positive"}


def test_distribution_and_rate(spark):
    df = spark.createDataFrame([("Positive", True), ("Positive", False), ("Negative", False)],
                               "sentiment string, fallback_applied boolean")
    d = {r.label: r["count"] for r in SC.sentiment_distribution(df).collect()}
    assert d == {"Positive": 2, "Negative": 1, "Total": 3}
    r = SC.fallback_rate(df).collect()[0]
    assert (r.rows, r.fallback_rows) == (3, 1) and abs(r.fallback_rate - 1 / 3) < 1e-12
    share = {x.sentiment: x.share_pct for x in SC.sentiment_share(df).collect()}
    assert abs(share["Positive"] - 200 / 3) < 1e-9
    assert F is not None


def test_score_upload_outputs_share_one_scoring(spark):
    from textpool.operators import scoring as SC

    class ByLength:
        def __call__(self):
            def score(texts):
                return pd.DataFrame({"l0": 0.0, "l1": 0.0, "l2": texts.str.len().astype(float)})
            return score

    entries = spark.createDataFrame([(str(i), "x" * (i % 5)) for i in range(40)], "id string, text string").coalesce(1)
    out = SC.score_upload(entries, ByLength())
    preds = out["predictions"].collect()
    dist = {r.label: r["count"] for r in out["distribution"].collect()}
    fb = out["fallback"].collect()[0]
    assert len(preds) == 24 and dist["Total"] == 24 and fb.rows == 24  # lengths 0 and 1 (16 of 40) dropped
    assert sum(dist[k] for k in dist if k != "Total") == 24


def test_text_model_learns_saves_and_scores(spark, tmp_path):
    """Held-out texts with known answers; a null text, an unseen text and a clashing column."""
    from textpool.operators import features as FE
    from textpool.operators import scoring as SC
    words = {0: "bad awful broken", 1: "plain usual average", 2: "good lovely splendid"}
    train = [(f"{w} thing number {i}", y) for y, ws in words.items() for i in range(12) for w in ws.split()]
    model = FE.fit_text_model(spark.createDataFrame(train, "text string, y int"))
    model.save(str(tmp_path / "model"))
    rows = [(f"a thing that is {w}", y) for y, ws in words.items() for w in ws.split()] + [(None, None), ("zzz", None), ("", None)]
    test = spark.createDataFrame([(i, t, y, 7) for i, (t, y) in enumerate(rows)], "id int, text string, y int, terms int")
    scored = FE.TextModel.load(str(tmp_path / "model")).score_frame(test)
    assert scored.columns == ["id", "text", "y", "terms", "l0", "l1", "l2"]
    out = SC.predict_from_logits(scored, enabled=False).collect()
    assert len(out) == len(rows) and all(r["terms"] == 7 for r in out)
    known = [r for r in out if r["y"] is not None]
    assert [r["pred_id"] for r in known] == [r["y"] for r in known]
    blank = {(r["l0"], r["l1"], r["l2"]) for r in out if r["y"] is None}
    assert len(blank) == 1  # none of them holds a known term


def test_text_vocabulary_against_plain_counts(spark):
    from collections import Counter
    from textpool.operators import features as FE
    texts = ["aa bb aa", "bb cc", None, "", "aa bb aa bb", "x"]
    got = {r["term"]: (r["df"], r["total"]) for r in FE.text_vocabulary(
        spark.createDataFrame([(t,) for t in texts], "text string"), 100, min_df=1).collect()}
    total, df = Counter(), Counter()
    for t in texts:
        tok = [w for w in (t or "").split() if len(w) > 1]
        terms = tok + [" ".join(p) for p in zip(tok, tok[1:])]
        total.update(terms)
        df.update(set(terms))
    assert got == {t: (df[t], n) for t, n in total.items()}
