import random

from textpool.operators import experiments as EX


def _replay(f1s, patience=2, delta=1e-4):
    best, stale, out = -1.0, 0, []
    for e, f in enumerate(f1s, 1):
        imp = f > best + delta
        out.append((e, imp))
        if imp:
            best, stale = f, 0
            continue
        stale += 1
        if stale >= patience:
            break
    return out


def _hist(spark, runs):
    rows = [(rid, e, 0.0, 0.0, f) for rid, f1s in runs.items() for e, f in enumerate(f1s, 1)]
    return spark.createDataFrame(rows, "run_id string, epoch int, train_loss double, val_loss double, val_macro_f1 double")


def test_published_trace_all_improve(spark):
    h = _hist(spark, {"primary": [0.771450, 0.796239, 0.818709, 0.846129]})
    out = EX.select_epochs(h).orderBy("epoch").collect()
    assert [r.improved for r in out] == [True] * 4
    best = EX.best_checkpoint(EX.select_epochs(h)).collect()[0]
    assert (best.best_epoch, best.best_val_macro_f1, best.epochs_ran) == (4, 0.846129, 4)


def test_fold_matches_sequential_replay(spark):
    rnd = random.Random(3)
    runs = {f"r{i}": [round(rnd.choice([rnd.random(), 0.5, 0.50005]), 5) for _ in range(rnd.randint(1, 9))]
            for i in range(60)}
    got = {}
    for r in EX.select_epochs(_hist(spark, runs)).collect():
        got.setdefault(r.run_id, []).append((r.epoch, r.improved))
    for rid, f1s in runs.items():
        assert sorted(got[rid]) == _replay(f1s), rid


def test_min_delta_is_not_running_max(spark):
    out = EX.select_epochs(_hist(spark, {"r": [0.5, 0.55, 0.62, 0.61]}), patience=5, min_delta=0.1).orderBy("epoch").collect()
    assert [r.improved for r in out] == [True, False, True, False]


def test_ablation_grid(spark):
    cfg = spark.createDataFrame([(a, b, 100 + 10 * a + b) for a in (False, True) for b in (False, True)],
                                "use_hf_train_extra boolean, merge_hard_examples boolean, train_pool_size int")
    g = sorted(EX.ablation_grid(cfg).collect(), key=lambda r: r.run_id)
    assert [r.run_id for r in g] == [f"abl_{i:02d}" for i in range(1, 9)]
    assert [r.requires_retrain for r in g] == [False, False] + [True] * 6
    assert [r.confidence_fallback_enabled for r in g] == [False, True] * 4
    from pyspark.sql import functions as F
    runs = EX.ablation_grid(cfg).withColumn("accuracy", F.lit(0.9)).withColumn("macro_f1", F.lit(0.8))
    pairs = EX.ablation_pairs(runs).collect()
    assert len(pairs) == 4 and all(p.no_change for p in pairs)


def test_seed_variance_population_std(spark):
    runs = spark.createDataFrame([("g", 0.8, 3), ("g", 0.9, 4), ("g", None, 2), ("h", None, 1)],
                                 "grp string, best_val_macro_f1 double, epochs_ran int")
    r = {x.grp: x for x in EX.seed_variance(runs, "grp").collect()}
    assert abs(r["g"].mean_val_macro_f1 - 0.85) < 1e-12 and abs(r["g"].std_val_macro_f1 - 0.05) < 1e-12
    assert r["g"].valid_runs == 2 and r["h"].mean_val_macro_f1 is None
