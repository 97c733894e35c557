"""Blocks of texts: terms and tokens leave a block once; results equal plain Python counts across many small blocks."""

import collections
import math
import random

import pyarrow as pa
import pytest

from textpool.operators import blocks as B
from textpool.operators import features as FE


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["çok", "x"]
    return [None, "", " . ", "x"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(120)]


@pytest.fixture
def small_blocks(monkeypatch):
    deal = B.deal
    monkeypatch.setattr(B, "deal", lambda *a: deal(*a, limit=2_000))


def test_cut_keeps_every_string_in_order():
    values = pa.array(texts())
    parts = list(B.cut(values, 1_000))
    assert len(parts) > 10 and [x for p in parts for x in p.to_pylist()] == values.to_pylist()
    assert list(B.cut(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("max_features", [None, 50])
def test_tfidf_across_blocks_against_plain_counts(spark, small_blocks, max_features):
    rows = [(i % 100, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    frame = FE.tfidf_relational(docs, max_features=max_features)
    got = sorted((r.id, r.term, round(r.tfidf, 9)) for r in frame.collect())
    terms = []
    for _, t in rows:
        k = [w for w in (t or "").split() if len(w) > 1 and w != "."]
        terms.append(collections.Counter(k + [f"{a} {b}" for a, b in zip(k, k[1:], strict=False)]))
    df, total = collections.Counter(t for c in terms for t in c), collections.Counter()
    for c in terms:
        total.update(c)
    kept = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:max_features]
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in kept}
    want = []
    for (i, _), c in zip(rows, terms, strict=True):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want += [(i, t, round(x / norm, 9)) for t, x in w.items()]
    assert got == sorted(want)


def shuffled_tokens(df):
    """Fields of the rows that the plan's exchanges deal."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, [line for line in plan.splitlines() if "Exchange" in line]


def test_no_row_per_document_and_term_is_shuffled(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "id long, text string")
    for df in (FE.tfidf_relational(docs), FE.encode_fixed(docs, FE.build_vocabulary(docs))):
        plan, exchanges = shuffled_tokens(df)
        assert "FlatMapCoGroupsInArrow" in plan and not any("_row" in e or "pos" in e for e in exchanges)


def test_windows_across_blocks(spark, small_blocks):
    rows = [(i % 100, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    vocab = FE.build_vocabulary(docs, 20)
    ids = {r.token: r.token_id for r in vocab.collect()}
    want = []
    for i, t in rows:
        k = [ids.get(w, 1) for w in (t or "").split() if w != "."]
        for w in range(max(1, -(-len(k) // 10))):
            s = [2, *k[10 * w:10 * w + 10], 3]
            want.append((i, w, s + [0] * (12 - len(s)), [1] * len(s) + [0] * (12 - len(s))))
    assert sorted(tuple(r) for r in FE.encode_fixed(docs, vocab, max_len=12).collect()) == sorted(want)
