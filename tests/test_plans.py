"""Exact top-k on both paths, and the plan properties the operators rely on."""

import random

import pandas as pd
from pyspark.sql import functions as F

from textpool.functions.arrays import explode_values
from textpool.functions.hashing import hex_bucket, seeded_hex
from textpool.functions.text import norm_join_key
from textpool.operators import aspects as AS
from textpool.operators import features as FE
from textpool.operators import ranking as R
from textpool.operators.scoring import apply_scorer


def _counts(spark, n=2000, seed=7):
    rng = random.Random(seed)
    rows = [(f"t{i:05d}", rng.randint(1, 40)) for i in range(n)]  # many ties on n, terms unique
    return rows, spark.createDataFrame(rows, "term string, n int").repartition(5)


def test_top_k_paths_agree_with_brute_force(spark):
    rows, df = _counts(spark)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    order = [F.desc("n"), F.asc("term")]
    # single-task top-k, the range-partitioned rank, and the rank over the count-bucket candidates
    for limit, cnt in ((10**9, None), (0, None), (0, "n")):
        for k in (1, 300, 1999):
            got = R.top_k(df, k, order, rank_col="rk", n_parts=7, single_task_limit=limit, desc_count=cnt).collect()
            assert sorted((r.rk, r.term, r.n) for r in got) == [(i, t, n) for i, (t, n) in enumerate(want[:k])]
        assert R.top_k(df, 10**6, order, single_task_limit=0, desc_count=cnt).count() == len(rows)


def test_vocabulary_ids_same_on_both_paths(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 30))) for i in range(60)],
                                 "id long, text string")
    small = {tuple(r) for r in FE.build_vocabulary(docs, 25).collect()}
    old = R.TOPK_SINGLE_TASK_LIMIT
    try:
        R.TOPK_SINGLE_TASK_LIMIT = 0
        big = {tuple(r) for r in FE.build_vocabulary(docs, 25).collect()}
    finally:
        R.TOPK_SINGLE_TASK_LIMIT = old
    assert small == big and sorted(t for _, t in small) == list(range(4, 29))


def test_explode_values_matches_explode_without_inferred_filter(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "d")], "id int, text string")
    toks = F.regexp_extract_all(F.col("text"), F.lit(r"\w+"), 0)
    got = explode_values(df, ["id"], toks, "tok")
    want = df.select("id", F.explode(toks).alias("tok"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan  # no re-evaluation of the array below the generator


def test_scorer_mask_scores_only_selected_rows(spark):
    seen = []

    class Counting:
        def __call__(self):
            def score(texts):
                seen.extend(texts.tolist())
                return pd.DataFrame({"l0": texts.str.len().astype(float), "l1": 0.0, "l2": 0.0})
            return score

    df = spark.createDataFrame([("a", True), ("bb", False), ("ccc", True), ("dd", None)], "text string, keep boolean")
    out = {r.text: r.l0 for r in apply_scorer(df.coalesce(1), Counting(), where=F.col("keep")).collect()}
    assert out["a"] == 1.0 and out["ccc"] == 3.0
    assert (out["bb"] is None or out["bb"] != out["bb"]) and (out["dd"] is None or out["dd"] != out["dd"])


def test_keep_top_aspects_semi_join(spark):
    rows = [(str(i), f"a{i % 4}", "Positive", 99.0) for i in range(40)] + [("x", "a0", "Negative", 99.0)]
    df = spark.createDataFrame(rows, "id string, detected_aspect string, sentiment string, confidence_score double")
    kept = AS.keep_top_aspects(df, k=1).collect()
    assert sorted(map(tuple, AS.keep_top_aspects(df, k=1, materialise=False).collect())) == sorted(map(tuple, kept))
    assert {r.detected_aspect for r in kept} == {"a0"} and len(kept) == 11


def test_join_keys_and_buckets_are_non_nullable(spark):
    df = spark.createDataFrame([("Ab ",)], "s string")
    out = df.select(norm_join_key("s").alias("k"), hex_bucket(seeded_hex(42, "s"), 64).alias("b"))
    assert [f.nullable for f in out.schema.fields] == [False, False]


def test_stratified_split_scans_its_input_once(spark, tmp_path):
    from textpool.operators import pool as P
    path = str(tmp_path / "pool.parquet")
    spark.createDataFrame([(f"s{i % 300}", i % 3) for i in range(3000)], "Sentence string, Polarity int") \
        .write.parquet(path)
    out = P.stratified_split(P.majority_dedup(spark.read.parquet(path)))
    assert len(out.collect()) == 300
    executed = out._jdf.queryExecution().executedPlan().toString()  # the final adaptive plan
    assert "isFinalPlan=true" in executed
    # the deduplicated input feeds quotas, bucket counts and ranks through one exchange
    assert "ReusedExchange" in executed or executed.count("FileScan parquet") == 1


def test_deep_page_equals_offset_page(spark):
    from textpool.operators import explore as X
    rows = [(f"id{i:04d}", None if i % 17 == 0 else f"t{i % 50:02d}") for i in range(1200)]
    df = spark.createDataFrame(rows, "id string, text string").repartition(6)
    for direction in ("asc", "desc"):
        shallow = [tuple(r) for r in X.page(df, 7, "text", direction).collect()]
        old = R.TOPK_SINGLE_TASK_LIMIT
        try:
            R.TOPK_SINGLE_TASK_LIMIT = 0
            deep = [tuple(r) for r in X.page(df, 7, "text", direction).collect()]
        finally:
            R.TOPK_SINGLE_TASK_LIMIT = old
        assert deep == shallow and len(deep) == 25


def _docs(spark):
    return spark.createDataFrame([(i, " ".join(f"w{(i * j) % 53}" for j in range(1, 40))) for i in range(80)],
                                 "id long, text string")


def test_tfidf_vocabulary_cut_has_no_single_task_topk(spark):
    plan = FE.tfidf_relational(_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan  # the 80,000-term cut is a range-partitioned rank


def test_encoder_keeps_every_token_in_windows(spark):
    docs = _docs(spark)
    vocab = FE.build_vocabulary(docs)
    rows = FE.encode_fixed(docs, vocab, max_len=12).collect()
    assert all(len(r.input_ids) == len(r.attention_mask) == 12 for r in rows)
    ids = {r.token: r.token_id for r in vocab.collect()}
    for d in docs.collect():
        own = sorted((r.window_no, r.input_ids, r.attention_mask) for r in rows if r.id == d.id)
        assert [w for w, *_ in own] == list(range(4))
        body = [i for _, x, m in own for i in x[1:sum(m) - 1]]
        assert body == [ids[t] for t in d.text.split()]
    empty = FE.encode_fixed(spark.createDataFrame([(1, ""), (2, None)], "id long, text string"), vocab, max_len=4).collect()
    assert sorted((r.id, r.window_no, r.input_ids) for r in empty) == [(1, 0, [2, 3, 0, 0]), (2, 0, [2, 3, 0, 0])]


def test_counts_move_digests_not_texts(spark):
    from textpool.operators import pool as P
    a = spark.createDataFrame([("x", 1)], "Sentence string, Polarity int")
    for df in (P.override_counts(a, a), P.split_overlap(a, a, a)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
        assert keys and all("_nk" in k or "_k#" in k for k in keys) and "sha2" in plan


def test_sample_has_no_single_task_topk(spark):
    from textpool.operators import pool as P
    df = spark.range(1000).selectExpr("cast(id as string) as Sentence", "1 as Polarity")
    assert "TakeOrderedAndProject" not in P.seeded_sample(df, 10)._jdf.queryExecution().executedPlan().toString()
