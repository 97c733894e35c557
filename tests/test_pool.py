import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from textpool.operators import pool as P
from textpool.operators.ranking import with_position, with_seeded_rank


def _df(spark, rows):
    return spark.createDataFrame(rows, "Sentence string, Polarity int")


def test_majority_vote(spark):
    out = P.majority_dedup(_df(spark, [("s", 0), ("s", 1), ("s", 1)])).collect()
    assert [tuple(r) for r in out] == [("s", 1)]


def test_majority_tie_smallest_label(spark):
    assert P.majority_dedup(_df(spark, [("s", 2), ("s", 0)])).collect()[0]["Polarity"] == 0
    assert P.majority_dedup(_df(spark, [("s", 2), ("s", 1), ("s", 2), ("s", 1)])).collect()[0]["Polarity"] == 1


def test_majority_empty_and_idempotent(spark):
    assert P.majority_dedup(_df(spark, [])).count() == 0
    rows = [("a", 0), ("a", 2), ("b", 1), ("b", 1), ("c", 2), ("A", 0)]
    once = P.majority_dedup(_df(spark, rows))
    assert sorted(map(tuple, P.majority_dedup(once).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, once.collect())) == [("A", 0), ("a", 0), ("b", 1), ("c", 2)]


def test_majority_hot_key_repartition_invariant(spark):
    rows = [("hot", i % 3) for i in range(3000)] + [("hot", 1)] + [(f"k{i}", i % 3) for i in range(500)]
    a = sorted(map(tuple, P.majority_dedup(_df(spark, rows)).collect()))
    b = sorted(map(tuple, P.majority_dedup(_df(spark, rows).repartition(7)).collect()))
    assert a == b and ("hot", 1) in a


def test_override_merge_and_counts(spark):
    base = _df(spark, [("Hello", 0), ("hello ", 2), ("other", 1), ("keep", 2)])
    hard = _df(spark, [("HELLO", 1), ("new one", 0)])
    merged = sorted(map(tuple, P.merge_overrides(base, hard).collect()))
    assert merged == [("HELLO", 1), ("keep", 2), ("new one", 0), ("other", 1)]
    c = P.override_counts(base, hard).collect()[0].asDict()
    assert c == {"hard_rows": 2, "overrides": 1, "new_rows": 1, "pool_before": 4, "pool_after": 4}


def test_leakage_report_and_removal(spark):
    train = _df(spark, [(f"t{i}", 0) for i in range(30)] + [("Shared", 1), ("X", 2)])
    val = _df(spark, [("shared ", 1), ("x", 0), ("x", 0), ("only val", 2)] + [(f"T{i}", 0) for i in range(25)])
    rep = P.leakage_report(train, val).collect()[0]
    assert (rep.train_size, rep.val_size) == (32, 29)
    assert rep.overlap_count == 27
    assert rep.overlap_ratio_of_val == round(27 / 28, 4)  # 28 distinct val keys
    expected = sorted({"shared", "x"} | {f"t{i}" for i in range(25)})[:20]
    assert rep.overlap_samples == expected
    left = P.remove_leakage(train, val)
    assert left.count() == 5
    assert P.leakage_report(left, val).collect()[0].overlap_count == 0


def test_split_overlap(spark):
    a, b, c = _df(spark, [("a", 0), ("b", 0)]), _df(spark, [("b", 1), ("c", 1)]), _df(spark, [("c", 2), ("a", 2), ("d", 2)])
    r = P.split_overlap(a, b, c).collect()[0].asDict()
    assert r == {"train_val_overlap": 1, "train_test_overlap": 1, "val_test_overlap": 1}


def test_stratified_split_properties(spark):
    rows = [(f"s{i}", 0) for i in range(101)] + [(f"u{i}", 1) for i in range(17)] + [(f"v{i}", 2) for i in range(250)]
    df = _df(spark, rows)
    sp = P.stratified_split(df, seed=42, n_buckets=8)
    out = sp.collect()
    assert len(out) == len(rows) and len({r.Sentence for r in out}) == len(rows)
    sizes = Counter(r.split for r in out)
    n = len(rows)
    temp = math.ceil(n * 0.2)
    assert sizes["train"] == n - temp
    assert sizes["val"] == temp - math.ceil(temp * 0.5) and sizes["test"] == math.ceil(temp * 0.5)
    per = Counter((r.Polarity, r.split) for r in out)
    for cls, total in [(0, 101), (1, 17), (2, 250)]:
        assert abs(per[(cls, "train")] - 0.8 * total) <= 1.0
    # membership equals brute force: rank by md5(seed || Sentence) within class
    q = {r.Polarity: r for r in P.split_quotas(df).collect()}
    for cls in (0, 1, 2):
        ordered = sorted((r.Sentence for r in out if r.Polarity == cls),
                         key=lambda s: (hashlib.md5(("42" + s).encode()).hexdigest(), s))
        for i, s in enumerate(ordered):
            exp = "train" if i < q[cls].q_train else ("val" if i < q[cls].q_train + q[cls].q_val else "test")
            assert next(r.split for r in out if r.Sentence == s) == exp


def test_seeded_rank_matches_brute_force(spark):
    rows = [(f"k{i % 37}", i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, g int").repartition(5)
    got = with_seeded_rank(df, 7, ["key"], ["g"], n_buckets=4).select("key", "g", "_rank").collect()
    for g in range(3):
        keys = sorted((r.key for r in got if r.g == g), key=lambda k: (hashlib.md5(("7" + k).encode()).hexdigest(), k))
        ranks = sorted(((r._rank, r.key) for r in got if r.g == g))
        assert [k for _, k in ranks] == keys
        assert [rk for rk, _ in ranks] == list(range(len(keys)))


def test_seeded_sample_exact_and_partition_independent(spark):
    rows = [(f"s{i}", i % 3) for i in range(1000)] + [("dup", 1)] * 50
    df = _df(spark, rows)
    a = sorted(map(tuple, P.seeded_sample(df, 123, seed=42).collect()))
    b = sorted(map(tuple, P.seeded_sample(df.repartition(9), 123, seed=42).collect()))
    assert len(a) == 123 and a == b
    big = sorted(map(tuple, P.seeded_sample(df, 10**9, seed=42).collect()))
    assert len(big) == 1050
    c = sorted(map(tuple, P.seeded_sample(df, 123, seed=42, n_buckets=4).collect()))
    c64 = sorted(map(tuple, P.seeded_sample(df.repartition(5), 123, seed=42, n_buckets=64).collect()))
    every = sorted(map(tuple, P.seeded_sample(df, 10**6, seed=42, n_buckets=64).collect()))
    assert c == a and c64 == a and every == big


def test_class_weights(spark):
    import numpy as np
    labels = [0] * 10 + [1] * 2 + [2] * 5
    w = {r.Polarity: r.weight for r in P.class_weights(spark.createDataFrame([(x,) for x in labels], "Polarity int"),
                                                         neutral_boost=1.5).collect()}
    counts = np.bincount(labels, minlength=3).astype(float)
    ref = counts.sum() / (3 * np.maximum(counts, 1.0))
    ref = ref / ref.mean()
    ref[1] *= 1.5
    ref = ref / ref.mean()
    assert np.allclose([w[0], w[1], w[2]], ref)
    empty = P.class_weights(spark.createDataFrame([], "Polarity int")).collect()
    assert sorted(r.weight for r in empty) == [1.0, 1.0, 1.0]


def test_sorted_rank_hot_key(spark):
    from textpool.operators.ranking import with_sorted_rank
    rows = [("hot", 1)] * 3000 + [(f"k{i}", i % 3) for i in range(1500)]
    df = spark.createDataFrame(rows, "Sentence string, Polarity int").repartition(6)
    got = with_sorted_rank(df, 42, ["Sentence", "Polarity"], n_parts=8).collect()
    assert sorted(r._rank for r in got) == list(range(4500))
    order = sorted(set(rows), key=lambda r: (hashlib.md5(("42" + r[0] + str(r[1])).encode()).hexdigest(), r))
    ranks = {}
    for r in got:
        ranks.setdefault((r.Sentence, r.Polarity), []).append(r._rank)
    start = 0
    for key in order:
        rk = sorted(ranks[key])
        assert rk == list(range(start, start + len(rk)))
        start += len(rk)


def test_with_position_consecutive(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumn("v", F.col("id") * 2)
    pos = with_position(df).collect()
    assert sorted((r.position, r.id) for r in pos) == [(i, i) for i in range(1000)]


def test_keyed_pools_count_like_texts(spark):
    base = _df(spark, [("Hello", 0), ("hello ", 2), ("hello ", 2), ("hello ", 1), ("other", 1), ("keep", 2)])
    hard = _df(spark, [("HELLO", 1), ("new one", 0)])
    val = _df(spark, [("KEEP ", 1), ("unseen", 0)])

    def build(f):
        merged = P.majority_dedup(P.merge_overrides(P.majority_dedup(f(base)), f(hard)))
        return merged, P.remove_leakage(merged, f(val))

    (text, kept_text), (dig, kept_dig) = build(lambda x: x), build(P.keyed)
    for a, b in ((text, dig), (kept_text, kept_dig)):
        assert sorted(r["count"] for r in P.label_distribution(a).collect()) == \
            sorted(r["count"] for r in P.label_distribution(b).collect())
    assert P.leakage_report(dig, val).collect() == P.leakage_report(text, val).collect()
    assert P.override_counts(P.keyed(base), P.keyed(hard)).collect() == P.override_counts(base, hard).collect()
    plan = P.label_distribution(kept_dig)._jdf.queryExecution().executedPlan().toString()
    assert "sha2" in plan


def test_sample_of_raw_rows_counts_nulls_as_empty(spark):
    df = spark.createDataFrame([(None, "a"), ("x", None), ("y", "b"), ("z", "c")], "tweet string, label string")
    got = P.seeded_sample(df, 4, key_cols=("tweet", "label")).collect()
    assert len(got) == 4
