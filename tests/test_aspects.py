from textpool.operators import aspects as AS
from textpool.operators.scoring import PairShapeScorer


def test_extraction_rules(spark):
    df = spark.createDataFrame([("1", "Kargo çok Geç geldi Ve Telefon telefon Ab KARGO"), ("2", "hiç yok"), ("3", "x")],
                               "id string, text string")
    rows = AS.aspect_rows(df, PairShapeScorer()).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.id, set()).add(r.detected_aspect)
    assert by_id["1"] == {"Kargo", "Geç", "Telefon", "KARGO"}  # 'Ve' blacklisted, 'Ab' too short
    assert by_id["2"] == {"GENERAL"}
    assert "3" not in by_id  # shorter than 2 characters
    gen = [r for r in rows if r.id == "2"][0]
    assert (gen.sentiment, gen.confidence_score) == ("Neutral", 0.0)


def test_rule_override(spark):
    df = spark.createDataFrame([("1", "Bu Ürün ne güzel ne kötü")], "id string, text string")
    rows = AS.aspect_rows(df, PairShapeScorer()).collect()
    assert rows and all((r.sentiment, r.confidence_score) == ("Neutral", 100.0) for r in rows)


def test_crosstab_top_k(spark):
    rows = [(str(i), "t", f"a{i % 12}", ["Negative", "Neutral", "Positive"][i % 3], 99.0) for i in range(120)]
    rows += [("x", "t", "GENEL", "Positive", 99.0), ("y", "t", "a0", "Positive", 10.0)]
    df = spark.createDataFrame(rows, "id string, text string, detected_aspect string, sentiment string, confidence_score double")
    ct = AS.aspect_crosstab(AS.report_filter(df)).collect()
    assert len(ct) == 10 and all(r.Total == 10 for r in ct)
    assert [r.detected_aspect for r in ct] == sorted(f"a{i}" for i in range(12))[:10]
