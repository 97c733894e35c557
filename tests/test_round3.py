"""Row identity of the encoders, sub-words, the streamed epoch fold, observed writes, nested artifacts."""

import collections
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpool.operators import experiments as EX
from textpool.operators import features as FE
from textpool.operators import pool as P
from textpool.operators import subwords as SW
from textpool.sources import files

REPEATED = [(1, "a b c"), (1, "c d"), (None, "a"), (None, "a"), (2, None), (3, "")]


def test_rows_that_share_an_id_are_encoded_apart(spark):
    docs = spark.createDataFrame(REPEATED + [(1, "w " * 300)], "id long, text string").repartition(3)
    enc = FE.encode_fixed(docs, FE.build_vocabulary(docs)).collect()
    assert all(len(r.input_ids) == 160 == len(r.attention_mask) for r in enc)
    sizes = sorted((str(r.id), r.window_no, sum(r.attention_mask)) for r in enc)
    assert sizes == [("1", 0, 4), ("1", 0, 5), ("1", 0, 160), ("1", 1, 144), ("2", 0, 2), ("3", 0, 2), ("None", 0, 3), ("None", 0, 3)]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (None, "aa bb"), (None, "aa bb")], "id long, text string")
    rows = FE.tfidf_relational(docs, min_df=1).collect()
    assert len(rows) == 12 and math.isclose(sum(r.tfidf ** 2 for r in rows), 4.0)
    assert sum(r.term == "aa" for r in rows) == 4


# sub-words

def brute_merges(ranks, part):
    pieces = [bytes([b]) for b in part]
    while True:
        best = min((ranks[a + b], i) for i, (a, b) in [*enumerate(zip(pieces, pieces[1:], strict=False))] + [(-1, (b"", b""))] if a + b in ranks) \
            if any(a + b in ranks for a, b in zip(pieces, pieces[1:], strict=False)) else None
        if best is None:
            return [ranks[p] for p in pieces]
        i = best[1]
        pieces[i:i + 2] = [pieces[i] + pieces[i + 1]]


MERGES = [b"ab", b"ba", b"aba", b"abab", b"cc", b"ccc", b" a", b"\xc3\xa9", b"\n\n"]


@pytest.fixture(scope="module")
def ranks():
    return {**{bytes([i]): i for i in range(256)}, **{m: 256 + i for i, m in enumerate(MERGES)}}


def subword_texts():
    rng = random.Random(2)
    return ["", None, "ab", "é\n\nab", "c" * 1000] + ["".join(rng.choice(["a", "b", "c", "é", "\n", "ß"]) for _ in range(rng.randrange(400))) for _ in range(40)]


def test_ranked_merges_equal_brute_force(spark, tmp_path, ranks):
    import base64
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % r for p, r in ranks.items()))
    texts = subword_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    encoder = SW.RankedMerges(str(path), pattern=r"(?s:.+)")
    got = {r.id: r.ids for r in docs.select("id", SW.subword_ids(F.col("text"), encoder).alias("ids")).collect()}
    assert got == {i: brute_merges(ranks, (t or "").encode()) for i, t in enumerate(texts)}


def test_longest_match_equals_brute_force_in_windows_and_comes_back(spark, ranks):
    texts = subword_texts()

    def brute(data):
        while data:
            n = max(k for k in range(1, 5) if data[:k] in ranks)
            yield ranks[data[:n]]
            data = data[n:]

    docs = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    encoder = SW.LongestMatch(ranks)
    rows = SW.encode_subwords(docs, encoder, 900, 901, 902, max_len=32).collect()
    want = []
    for i, t in enumerate(texts):
        ids = list(brute((t or "").encode()))
        for w in range(max(1, -(-len(ids) // 30))):
            body = [900, *ids[30 * w:30 * w + 30], 901]
            want.append((i % 7, w, body + [902] * (32 - len(body)), [1] * len(body) + [0] * (32 - len(body))))
    assert sorted(tuple(r) for r in rows) == sorted(want)
    back = docs.select("text", SW.subword_text(SW.subword_ids(F.col("text"), encoder), encoder).alias("b")).collect()
    assert all((r.text or "") == r.b for r in back)


def test_pieces_must_cover_the_text(spark):
    encode, _ = SW.LongestMatch({b"a": 0})()
    with pytest.raises(ValueError, match="no piece"):
        list(encode("ab"))


# W3

def replay(epochs, patience, min_delta, stop):
    best, stale, out = -1.0, 0, []
    for e, f1 in sorted(epochs):
        better = f1 is not None and f1 > best + min_delta
        best, stale = (f1, 0) if better else (best, stale + 1)
        out.append((e, better))
        if stop and stale >= patience:
            break
    return out


@pytest.mark.parametrize("stop", [True, False])
def test_epochs_are_replayed_in_order(spark, stop):
    rng = random.Random(1)
    runs = {k: [(e, rng.choice([None, float("nan"), rng.random(), 0.5])) for e in range(rng.randrange(1, 30))] for k in [*map(str, range(40)), None]}
    rows = [(k, e, 0.1, 0.2, f1, 1) for k, es in runs.items() for e, f1 in es]
    rng.shuffle(rows)
    history = spark.createDataFrame(rows, "run_id string, epoch int, train_loss double, val_loss double, val_macro_f1 double, size int")
    got = EX.select_epochs(history, early_stopping=stop).collect()
    want = [(k, e, b) for k, es in runs.items() for e, b in replay([(e, -9.0 if f is None or f != f else f) for e, f in es], EX.PATIENCE, EX.MIN_DELTA, stop)]
    assert sorted(((r.run_id, r.epoch, r.improved) for r in got), key=repr) == sorted(want, key=repr)
    assert EX.select_epochs(history.limit(0)).count() == 0


def test_a_run_of_a_million_epochs(spark):
    """The state is carried along the rows: nothing of the run is collected in the plan."""
    history = spark.range(1_000_000).select(F.lit(7).alias("run_id"), F.col("id").cast("int").alias("epoch"), F.lit(0.0).alias("train_loss"),
                                            F.lit(0.0).alias("val_loss"), (F.col("id") * 0.001).alias("val_macro_f1"))
    epochs = EX.select_epochs(history)
    assert "collect_list" not in epochs._jdf.queryExecution().toString()
    row = EX.best_checkpoint(epochs).first()
    assert (row.best_epoch, row.epochs_ran) == (999_999, 1_000_000)


# A5, S5

def test_a_landed_source_is_counted_while_it_is_written(spark, tmp_path):
    raw = spark.createDataFrame([("a\nb", "neg"), ("c", " Positive"), ("d", "?"), ("e", None), ("f", "1")], "Content string, Sentiment string")
    found = P.land_source(raw, str(tmp_path / "raw"), "Sentiment")
    assert found == {"columns": ["Content", "Sentiment"], "rows": 5, "labels": {"negative": 1, "neutral": 1, "positive": 1, "unlabelled": 2}}
    back = files.read_csv(spark, str(tmp_path / "raw"))
    assert sorted(back.select("Content").collect()) == sorted(raw.select("Content").collect())


def test_observed_write_counts_the_rows_it_writes(spark, tmp_path):
    back, seen = P.observed_write(spark.range(100), str(tmp_path / "t"), "t", top=F.max("id"))
    assert seen == {"rows": 100, "top": 99} and back.count() == 100
    assert P.observed_write(spark.range(0), str(tmp_path / "u"), "u")[1] == {"rows": 0}


# K2

def test_artifacts_are_nested_json(spark, tmp_path):
    epochs = spark.createDataFrame([("r", 2, 0.1, 0.2, 0.6, True), ("r", 1, 0.3, 0.4, 0.5, True), ("s", 1, None, None, 0.0, False)],
                                   "run_id string, epoch int, train_loss double, val_loss double, val_macro_f1 double, improved boolean")
    sizes = spark.createDataFrame([("r", 10, 3)], "run_id string, train long, val long")
    art = EX.experiment_artifacts(epochs, sizes, {"random_seed": 42, "early_stopping": True}, {"device": "cpu", "use_amp": False}, "m", "p", ["N", "P"])
    art.coalesce(1).write.json(str(tmp_path / "a"))
    name = next(n for n in os.listdir(tmp_path / "a") if n.endswith(".json"))
    rows = {r["run_id"]: r for r in map(json.loads, (tmp_path / "a" / name).read_text().splitlines())}
    r = rows["r"]
    assert r["config_snapshot"] == {"random_seed": 42, "early_stopping": True} and r["runtime"] == {"device": "cpu", "use_amp": False}
    assert r["dataset_sizes"] == {"train": 10, "val": 3} and r["class_names"] == ["N", "P"] and r["epochs_ran"] == 2 and r["best_val_macro_f1"] == 0.6
    assert [e["epoch"] for e in r["epoch_history"]] == [1, 2] and r["epoch_history"][1] == {
        "epoch": 2, "train_loss": 0.1, "val_loss": 0.2, "val_macro_f1": 0.6, "improved": True}
    assert rows["s"]["best_val_macro_f1"] == -1.0 and r["created_at_utc"].endswith(("Z", "+00:00"))


def test_multi_seed_summary(spark):
    runs = spark.createDataFrame([("j", 456, "c", None, None), ("j", 42, "a", 0.5, 3), ("j", 123, "b", 0.7, 4), ("k", 1, "z", None, None)],
                                 "job string, seed long, run_name string, best_val_macro_f1 double, epochs long")
    got = {r.job: r for r in EX.multi_seed_summary(runs, "job").collect()}
    assert got["j"].seeds == [42, 123, 456] and math.isclose(got["j"].mean_val_macro_f1, 0.6) and math.isclose(got["j"].std_val_macro_f1, 0.1)
    assert [x.run_name for x in got["j"].results] == ["a", "b", "c"] and got["k"].mean_val_macro_f1 is None


# M3

def dense_optimum(x, y, weight):
    """Newton's method on |w|²/2 (without the intercept, the last weight) + sum of weighted losses."""
    penalty = np.ones(x.shape[1])
    penalty[-1] = 0
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = penalty * w + x.T @ (weight * (p - y))
        hess = np.diag(penalty) + (x.T * (weight * p * (1 - p))) @ x
        w = w - np.linalg.solve(hess, grad)
    return w


def test_fitted_margins_are_the_optimum_of_a_dense_solver(spark):
    rng = random.Random(3)
    words = [["bad", "awful", "slow"], ["okay", "normal", "plain"], ["good", "great", "fast"]]
    rows = []
    for _ in range(150):
        y = rng.choice([0, 0, 0, 1, 2])
        rows.append((" ".join(rng.choice(words[y] if rng.random() < 0.6 else words[rng.randrange(3)]) for _ in range(6)), y))
    train = spark.createDataFrame(rows, "text string, y int")
    model = FE.fit_text_model(train, max_iter=500, tol=1e-12)
    got = model.score_frame(train).select("text", "l0", "l1", "l2").collect()
    terms = lambda t: (lambda k: k + [f"{a} {b}" for a, b in zip(k, k[1:], strict=False)])(t.split())
    df = collections.Counter(t for x, _ in rows for t in set(terms(x)))
    kept = sorted(t for t, n in df.items() if n >= 2)
    x = np.zeros((len(rows), len(kept) + 1))
    for i, (t, _) in enumerate(rows):
        for term in terms(t):
            if df[term] >= 2:
                x[i, kept.index(term)] += math.log((1 + len(rows)) / (1 + df[term])) + 1
        x[i] /= np.linalg.norm(x[i])
        x[i, -1] = 1.0
    want = {}
    for c in range(3):
        y = np.array([r[1] == c for r in rows], float)
        margins = x @ dense_optimum(x, y, np.where(y == 1, len(rows) / (3 * y.sum()), 1.0))
        for (t, _), m in zip(rows, margins, strict=True):
            want.setdefault(t, []).append(m)
    for r in got:
        assert np.allclose([r.l0, r.l1, r.l2], want[r.text][:3], atol=1e-4)


def test_a_class_without_rows_is_never_predicted(spark):
    train = spark.createDataFrame([("aa bb", 0), ("aa cc", 0), ("dd bb", 2), ("dd cc", 2)] * 3, "text string, y int")
    pred = FE.tfidf_logreg(train, train)
    assert all(r.prediction == r.y for r in pred.collect())
