"""Round 4's findings: regressions are fitted on every training row; terms travel packed, once."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression

from textpool.operators import blocks as B
from textpool.operators import features as FE
from textpool.plans import feature_queries as FQ
from textpool.plans import inputs as I


def test_a_fit_reads_every_row(spark):
    """Equal texts tell nothing: the margins are the log odds of the weighted classes, of all 60,000 rows."""
    train = spark.range(60_000).selectExpr("'aa bb' AS text", "CAST(id % 3 AS INT) AS y")
    row = FE.fit_text_model(train).score_frame(train.limit(1)).first()
    assert all(math.isclose(x, math.log(0.5), abs_tol=1e-6) for x in (row.l0, row.l1, row.l2))


def many_labelled(spark, folder):
    """Tables of 66,000 labelled documents, of which about 52,800 are of the train split."""
    docs = spark.range(66_000).selectExpr("id AS doc_id", "'en' AS lang", "concat('word ', id % 7, ' text') AS text")
    labels = spark.range(66_000).selectExpr("id AS doc_id", "CAST(id % 3 = 2 AS INT) AS quality", "CAST(id % 3 = 0 AS INT) AS toxic")
    turns = spark.createDataFrame([(1, 0, "user", "word text"), (1, 1, "assistant", "")], "conv_id long, turn int, role string, text string")
    events = spark.createDataFrame([(1, "purchase")], "event_id long, event_type string")
    for name, df in (("documents", docs), ("labels", labels), ("conversations", turns), ("events", events)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder), I.split_docs(spark, str(folder)).filter("split = 'train'").count()


def rows_of_fits(monkeypatch):
    """Fills with the rows that each regression gets."""
    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df, *a: (seen.append(df.count()), fit(self, df, *a))[1], raising=False)
    return seen


def test_tfidf_logreg_is_fitted_on_every_row(spark, tmp_path, monkeypatch):
    d, n = many_labelled(spark, tmp_path)
    seen = rows_of_fits(monkeypatch)
    FQ.tfidf_logreg_q(spark, d)
    assert n > 50_000 and seen == [n] * 3


def test_trained_comparison_is_fitted_on_every_row(spark, tmp_path, monkeypatch):
    d, n = many_labelled(spark, tmp_path)
    seen = rows_of_fits(monkeypatch)
    rows = {r["model"]: r for r in FQ.trained_comparison(spark, d).collect()}
    assert n > 50_000 and seen == [n] * 3
    assert rows["tfidf_logreg"]["predicted"] == rows["majority_class"]["rows"] > 6_000


def test_trained_scorer_is_fitted_on_every_row(spark, tmp_path, monkeypatch):
    d, n = many_labelled(spark, tmp_path)
    seen = rows_of_fits(monkeypatch)
    rows = FQ.trained_scorer(spark, d).collect()
    assert n > 50_000 and seen == [n] * 3
    assert [r["id"] for r in rows if r["label_follows_policy"]] == [r["id"] for r in rows] and "c1-0" in {r["id"] for r in rows}


def texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["çok", "ağaç", "x"]
    return [None, "", " . ", "x", "w1"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(50))) for _ in range(100)]


def wanted(rows, kept=None):
    """(id, term, weight) by plain counts."""
    terms = []
    for _, t in rows:
        k = [w for w in (t or "").split() if len(w) > 1]
        terms.append(collections.Counter(k + [f"{a} {b}" for a, b in zip(k, k[1:], strict=False)]))
    df, total = collections.Counter(t for c in terms for t in c), collections.Counter()
    for c in terms:
        total.update(c)
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:kept]}
    out = []
    for (i, _), c in zip(rows, terms, strict=True):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        out += [(str(i), t, round(x / math.sqrt(sum(y * y for y in w.values())), 9)) for t, x in w.items()]
    return sorted(out)


@pytest.mark.parametrize("kept", [None, 40])
def test_tfidf_across_blocks_and_buckets(spark, monkeypatch, kept):
    deal = B.deal
    monkeypatch.setattr(B, "deal", lambda *a: deal(*a, limit=1_500))
    monkeypatch.setattr(B, "BUCKET_BYTES", 2_000)
    rows = [(None if i == 7 else f"d{i % 60}", t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "id string, text string").repartition(3)
    got = [(str(r.id), r.term, round(r.tfidf, 9)) for r in FE.tfidf_relational(docs, max_features=kept).collect()]
    assert sorted(got) == wanted(rows, kept)


def test_no_row_per_block_and_term_is_shuffled(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "id long, text string")
    plan = FE.tfidf_relational(docs)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line or "Window" in line]
    assert any("_bucket" in x for x in dealt) and not any("term#" in x or "Window" in x for x in dealt)


def test_tfidf_of_nothing(spark):
    for rows in ([], [(1, None), (None, "")]):
        for kept in (None, 5):
            df = FE.tfidf_relational(spark.createDataFrame(rows, "id long, text string"), max_features=kept)
            assert df.collect() == [] and df.dtypes == [("id", "bigint"), ("term", "string"), ("tfidf", "double")]


def test_packed_strings_and_numbers_come_back():
    for values in ([""], ["a", "", "ç b"], [""] * 3):
        assert B.strings(B.packed_strings(pa.array(values))).to_pylist() == values
    assert B.strings(B.packed_strings(pa.array([None, "a"], pa.string()))).to_pylist() == ["", "a"]
    for values in ([], [0], [1, 255, 256, 2**40]):
        assert B.numbers(B.packed_numbers(np.array(values, np.int64))).tolist() == values


def test_a_term_has_one_bucket_in_every_block():
    buckets = {}
    for part in (texts()[:50], texts()[50:]):
        terms, codes, rows, starts = B.bucket_codes(pa.array(part), 7)
        plain = B.term_codes(pa.array(part))
        assert sorted(zip(rows.tolist(), terms.take(pa.array(codes)).to_pylist(), strict=True)) == sorted(
            zip(plain[2].tolist(), plain[0].take(pa.array(plain[1])).to_pylist(), strict=True))
        for i in range(7):
            for t in terms[int(starts[i]):int(starts[i + 1])].to_pylist():
                assert buckets.setdefault(t, i) == i
    assert set(buckets.values()) == set(range(7))
