"""Catalogue: ablation plan/pairs, epoch selection, best checkpoint, seed variance."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpool.functions.aggregates import count_where
from textpool.functions.labels import CLASS_NAMES
from textpool.operators import experiments as EX
from textpool.operators import metrics as M
from textpool.operators import pool as P
from textpool.operators import scoring as SC
from textpool.plans import inputs as I
from textpool.plans import sql as S
from textpool.plans.pool_queries import _POOL_CTES, training_pool_stages
from textpool.plans.registry import register
from textpool.session import scratch_path
from textpool.sources.tables import read_table


def epoch_history(spark, d):
    """lineitem as a training log: run = order, epoch = position of the line within the order
    (by line number, quantity, tax, discount; a handful per order), val_macro_f1 = quantity / 50,
    losses from tax and discount."""
    from pyspark.sql import Window
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_tax", "l_discount")
    return li.select(F.col("l_orderkey").alias("run_id"), F.row_number().over(w).alias("epoch"),
                     (F.col("l_tax") * 10).alias("train_loss"), (F.col("l_discount") * 10).alias("val_loss"),
                     (F.col("l_quantity") / 50).alias("val_macro_f1"))


_EPOCH_SQL = (
    "WITH RECURSIVE h AS (SELECT l_orderkey AS run_id, CAST(rn AS INTEGER) AS epoch, l_tax * 10 AS train_loss, "
    "l_discount * 10 AS val_loss, l_quantity / 50 AS val_macro_f1, rn FROM (SELECT *, row_number() OVER "
    "(PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax, l_discount) AS rn FROM lineitem)), "
    "r AS (SELECT run_id, epoch, train_loss, val_loss, val_macro_f1, rn, "
    "val_macro_f1 > CAST(-1.0 AS DOUBLE) + CAST(0.0001 AS DOUBLE) AS improved, "
    "CASE WHEN val_macro_f1 > CAST(-1.0 AS DOUBLE) + CAST(0.0001 AS DOUBLE) THEN val_macro_f1 ELSE CAST(-1.0 AS DOUBLE) END AS best, "
    "CASE WHEN val_macro_f1 > CAST(-1.0 AS DOUBLE) + CAST(0.0001 AS DOUBLE) THEN 0 ELSE 1 END AS stale FROM h WHERE rn = 1 "
    "UNION ALL SELECT h.run_id, h.epoch, h.train_loss, h.val_loss, h.val_macro_f1, h.rn, "
    "h.val_macro_f1 > r.best + CAST(0.0001 AS DOUBLE), "
    "CASE WHEN h.val_macro_f1 > r.best + CAST(0.0001 AS DOUBLE) THEN h.val_macro_f1 ELSE r.best END, "
    "CASE WHEN h.val_macro_f1 > r.best + CAST(0.0001 AS DOUBLE) THEN 0 ELSE r.stale + 1 END "
    "FROM r JOIN h ON h.run_id = r.run_id AND h.rn = r.rn + 1 WHERE r.stale < 2), "
    "best AS (SELECT run_id, max(CASE WHEN improved THEN epoch END) AS best_epoch, "
    "max(CASE WHEN improved THEN val_macro_f1 END) AS best_val_macro_f1, count(*) AS epochs_ran FROM r GROUP BY run_id)\n")


def _epochs(spark, d):
    return EX.select_epochs(epoch_history(spark, d))


def _rounded(df, cols):
    return M.round_cols(df, cols)


@register("epoch_selection", _EPOCH_SQL + "SELECT run_id, epoch, round(train_loss, 6) AS train_loss, "
          "round(val_loss, 6) AS val_loss, round(val_macro_f1, 6) AS val_macro_f1, improved FROM r", ("W3",))
def epoch_selection(spark, d):
    return _rounded(_epochs(spark, d), ["train_loss", "val_loss", "val_macro_f1"])


@register("best_checkpoint", _EPOCH_SQL + "SELECT run_id, best_epoch, round(best_val_macro_f1, 6) AS best_val_macro_f1, "
          "epochs_ran FROM best", ("W4",))
def best_checkpoint_q(spark, d):
    return _rounded(EX.best_checkpoint(_epochs(spark, d)), ["best_val_macro_f1"])


@register("seed_variance", _EPOCH_SQL + (
    "SELECT o.o_orderpriority, count(*) AS runs, count(CASE WHEN best_val_macro_f1 > 0 THEN 1 END) AS valid_runs, "
    "round(avg(CASE WHEN best_val_macro_f1 > 0 THEN best_val_macro_f1 END), 6) AS mean_val_macro_f1, "
    "round(stddev_pop(CASE WHEN best_val_macro_f1 > 0 THEN best_val_macro_f1 END), 6) AS std_val_macro_f1, "
    "round(avg(epochs_ran), 6) AS mean_epochs FROM best b JOIN orders o ON b.run_id = o.o_orderkey GROUP BY o.o_orderpriority"),
    ("A17",))
def seed_variance_q(spark, d):
    runs = EX.best_checkpoint(_epochs(spark, d))
    orders = read_table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    r = runs.join(orders, runs.run_id == orders.o_orderkey, "inner")
    return _rounded(EX.seed_variance(r, "o_orderpriority"), ["mean_val_macro_f1", "std_val_macro_f1", "mean_epochs"])


# ── K2 ──────────────────────────────────────────────────────────────────────
# The settings that a training run records.
RUN_CONFIG = {
    "random_seed": 42, "batch_size": 32, "epochs": 4, "learning_rate": 2e-5, "max_len": 160, "warmup_ratio": 0.1, "use_class_weights": True,
    "neutral_class_index": 1, "neutral_loss_boost": 1.0, "early_stopping": True, "early_stopping_patience": EX.PATIENCE,
    "early_stopping_min_delta": EX.MIN_DELTA, "merge_raw_absa_for_train": True, "use_hf_train_extra": True,
    "hf_dataset_id": "winvoker/turkish-sentiment-analysis-dataset", "hf_sample_size": 10_000, "hf_seed": 42, "merge_hard_examples": True,
    "leakage_guard_enabled": True, "confidence_fallback_enabled": True, "confidence_threshold": SC.CONFIDENCE_THRESHOLD,
    "confidence_fallback_label": SC.FALLBACK_LABEL,
}


def _artifacts(spark, d):
    """The artifacts of all runs; an order's line count and quantity stand for its training's sizes."""
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_quantity")
    sizes = li.groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.sum("l_quantity").cast("long").alias("train"), F.count(F.lit(1)).alias("val"))
    return EX.experiment_artifacts(_epochs(spark, d), sizes, RUN_CONFIG, {"device": "cpu", "use_amp": False}, "text-model", "text_model", CLASS_NAMES)


def _written_json(spark, df, name):
    """A table of nested reports, written as compressed JSON lines (all repeat their settings) and read back with its schema."""
    path = scratch_path(spark, name)
    df.write.json(path, compression="gzip")
    return spark.read.schema(df.schema).json(path)


_HISTORY_SQL = ("array_to_string(list(CAST(epoch AS VARCHAR) || ':' || CASE WHEN improved THEN '+' ELSE '-' END || "
                "CAST(CAST(round(val_macro_f1 * 50) AS BIGINT) AS VARCHAR) ORDER BY epoch), ' ')")


@register("experiment_artifact", _EPOCH_SQL + (
    "SELECT b.run_id, round(coalesce(best_val_macro_f1, -1), 6) AS best_val_macro_f1, CAST(epochs_ran AS INTEGER) AS epochs_ran, "
    "z.train_size, z.val_size, 42 AS random_seed, true AS early_stopping, 'Neutral' AS fallback_label, 'Negative,Neutral,Positive' AS classes, "
    f"h.history FROM best b JOIN (SELECT run_id, {_HISTORY_SQL} AS history FROM r GROUP BY run_id) h USING (run_id) "
    "JOIN (SELECT l_orderkey AS run_id, CAST(sum(l_quantity) AS BIGINT) AS train_size, count(*) AS val_size FROM lineitem GROUP BY 1) z "
    "USING (run_id)"), ("K2", "W3"))
def experiment_artifact(spark, d):
    back = _written_json(spark, _artifacts(spark, d), "artifacts")
    mark = F.transform("epoch_history", lambda e: F.concat(
        e["epoch"].cast("string"), F.lit(":"), F.when(e["improved"], "+").otherwise("-"), F.round(e["val_macro_f1"] * 50).cast("long").cast("string")))
    return back.select(
        "run_id", F.round("best_val_macro_f1", 6).alias("best_val_macro_f1"), "epochs_ran", F.col("dataset_sizes.train").alias("train_size"),
        F.col("dataset_sizes.val").alias("val_size"), F.col("config_snapshot.random_seed").alias("random_seed"),
        F.col("config_snapshot.early_stopping").alias("early_stopping"),
        F.col("config_snapshot.confidence_fallback_label").alias("fallback_label"), F.array_join("class_names", ",").alias("classes"),
        F.array_join(mark, " ").alias("history"))


@register("multi_seed_report", _EPOCH_SQL + (
    "SELECT o.o_custkey AS job, array_to_string(list(CAST(b.run_id AS VARCHAR) || ':' || CAST(epochs_ran AS VARCHAR) ORDER BY b.run_id), ' ') AS runs, "
    "round(avg(CASE WHEN best_val_macro_f1 <> 0 THEN best_val_macro_f1 END), 6) AS mean_val_macro_f1, "
    "round(stddev_pop(CASE WHEN best_val_macro_f1 <> 0 THEN best_val_macro_f1 END), 6) AS std_val_macro_f1 "
    "FROM best b JOIN orders o ON b.run_id = o.o_orderkey GROUP BY o.o_custkey"), ("K2", "A17"))
def multi_seed_report(spark, d):
    """A customer's orders stand for the seeds of one multi-seed job."""
    orders = read_table(spark, d, "orders", "o_orderkey", "o_custkey")
    runs = EX.best_checkpoint(_epochs(spark, d)).join(orders, F.col("run_id") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("job"), F.col("run_id").alias("seed"), F.concat(F.lit("multi_seed_"), "run_id").alias("run_name"),
        "best_val_macro_f1", F.col("epochs_ran").alias("epochs"))
    back = _written_json(spark, EX.multi_seed_summary(runs, "job"), "multi_seed")
    listed = F.transform("results", lambda r: F.concat(r["seed"].cast("string"), F.lit(":"), r["epochs"].cast("string")))
    return _rounded(back.select("job", F.array_join(listed, " ").alias("runs"), "mean_val_macro_f1", "std_val_macro_f1"),
                    ["mean_val_macro_f1", "std_val_macro_f1"])


# ── J8 / J9 ─────────────────────────────────────────────────────────────────
def pool_label_counts(spark, d):
    """(use_hf_train_extra, merge_hard_examples, n0, n1, n2): rows per label of the pool of each setting.

    Four real pool builds. They share their inputs, so those are written once,
    as digests (the pools are only counted), and read back by every variant.
    """
    st = training_pool_stages(spark, d, keyed=True, written=True)
    raw, extra, hard, val = (st[k] for k in ("merged_raw", "extra", "hard", "val"))
    variants = {
        (False, False): raw,
        (True, False): P.majority_dedup(P.union_pools(raw, extra)),
        (False, True): P.majority_dedup(P.merge_overrides(raw, hard)),
        (True, True): P.majority_dedup(P.merge_overrides(P.majority_dedup(P.union_pools(raw, extra)), hard)),
    }
    parts = [P.remove_leakage(v, val).agg(*[count_where(F.col("Polarity") == c).alias(f"n{c}") for c in range(3)])
             .select(F.lit(a).alias("use_hf_train_extra"), F.lit(b).alias("merge_hard_examples"), "n0", "n1", "n2")
             for (a, b), v in variants.items()]
    return P.union_pools(*parts)


def pool_variants(spark, d):
    """Training-pool size for each (extra, overrides) setting."""
    return pool_label_counts(spark, d).select("use_hf_train_extra", "merge_hard_examples",
                                              (F.col("n0") + F.col("n1") + F.col("n2")).alias("train_pool_size"))


_VARIANT_SQL = {
    (False, False): "SELECT * FROM merged_raw",
    (True, False): S.dedup("SELECT * FROM merged_raw UNION ALL SELECT * FROM extra"),
    (False, True): S.dedup(S.merge_overrides("SELECT * FROM merged_raw", "SELECT * FROM hard")),
    (True, True): S.dedup(S.merge_overrides(S.dedup("SELECT * FROM merged_raw UNION ALL SELECT * FROM extra"),
                                            "SELECT * FROM hard")),
}
_GRID_CTES = "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in _POOL_CTES.items()) + ",\n" + (
    "pv AS (" + " UNION ALL ".join(
        f"SELECT {str(a).lower()} AS use_hf_train_extra, {str(b).lower()} AS merge_hard_examples, count(*) AS train_pool_size "
        f"FROM ({S.remove_leakage(v, 'SELECT * FROM val')})" for (a, b), v in _VARIANT_SQL.items()) + "),\n"
    "grid AS (SELECT printf('abl_%02d', CAST(use_hf_train_extra AS INTEGER) * 4 + CAST(merge_hard_examples AS INTEGER) * 2 "
    "+ CAST(f AS INTEGER) + 1) AS run_id, use_hf_train_extra, merge_hard_examples, train_pool_size, "
    "f AS confidence_fallback_enabled, use_hf_train_extra OR merge_hard_examples AS requires_retrain, "
    "'Train + evaluate required for fair comparison.' AS notes FROM pv, (SELECT unnest([false, true]) AS f))\n")


@register("ablation_grid", _GRID_CTES + "SELECT * FROM grid", ("J8",))
def ablation_grid_q(spark, d):
    return EX.ablation_grid(pool_variants(spark, d))


def _pool_metrics(spark, d, pools):
    """accuracy and macro_f1 of one model per pool and fallback setting.

    A pool's model adds the log shares of its labels (add-one smoothed) to the
    logits of the scored rows, so what a pool holds decides what its model says.
    """
    keys = ["use_hf_train_extra", "merge_hard_examples"]
    total = F.col("n0") + F.col("n1") + F.col("n2")
    priors = pools.select(*keys, *[F.log((F.col(f"n{c}") + 1) / (total + 3)).alias(f"g{c}") for c in range(3)])  # four rows
    settings = F.array(*[F.struct(F.lit(a).alias(keys[0]), F.lit(b).alias(keys[1])) for a in (False, True) for b in (False, True)])
    rows = I.logits_table(spark, d).select("id", "y", "l0", "l1", "l2", F.explode(settings).alias("_k")).select("*", "_k.*")
    shifted = rows.join(F.broadcast(priors), keys).select(
        "id", "y", *keys, *[(F.col(f"l{c}") + F.col(f"g{c}")).alias(f"l{c}") for c in range(3)])
    pred = SC.predict_from_logits(shifted, enabled=True)
    # with fallback the final class counts, without it the raw one: one scored row serves both
    ev = pred.select("id", "y", *keys, F.explode(F.array(
        F.struct(F.lit(True).alias("confidence_fallback_enabled"), F.col("pred_id").alias("p")),
        F.struct(F.lit(False).alias("confidence_fallback_enabled"), F.col("raw_id").alias("p")))).alias("_e")).select("*", "_e.*")
    flags = [*keys, "confidence_fallback_enabled"]
    cmp = M.model_comparison(ev.withColumn("model", F.concat(*[F.col(f).cast("int").cast("string") for f in flags])))
    return cmp.select(*[(F.substring("model", i + 1, 1) == "1").alias(f) for i, f in enumerate(flags)], "accuracy", "macro_f1")


_PAIRS_SQL = _GRID_CTES.rstrip("\n") + (
    ", pl AS (" + " UNION ALL ".join(
        f"SELECT {str(a).lower()} AS a, {str(b).lower()} AS b, count(CASE WHEN Polarity = 0 THEN 1 END) AS n0, "
        f"count(CASE WHEN Polarity = 1 THEN 1 END) AS n1, count(CASE WHEN Polarity = 2 THEN 1 END) AS n2 "
        f"FROM ({S.remove_leakage(v, 'SELECT * FROM val')})" for (a, b), v in _VARIANT_SQL.items()) + "), "
    "sh AS (SELECT a, b, y, " + ", ".join(
        f"l{c} + ln(CAST(n{c} + 1 AS DOUBLE) / CAST(n0 + n1 + n2 + 3 AS DOUBLE)) AS l{c}" for c in range(3))
    + f" FROM ({S.LOGITS}) lg, pl), "
    f"es AS ({S.scored('SELECT * FROM sh', fallback=True)}), en AS ({S.scored('SELECT * FROM sh', fallback=False)}), "
    "ev AS (SELECT a, b, true AS f, y, pred_id AS p FROM es UNION ALL SELECT a, b, false, y, pred_id FROM en), "
    "conf AS (SELECT a, b, f, y, p, count(*) AS n FROM ev GROUP BY ALL), "
    "pc AS (SELECT a, b, f, c, sum(CASE WHEN y = c AND p = c THEN n ELSE 0 END) AS tp, "
    "sum(CASE WHEN y = c THEN n ELSE 0 END) AS support, sum(CASE WHEN p = c THEN n ELSE 0 END) AS predicted "
    "FROM conf, (SELECT unnest([0, 1, 2]) AS c) GROUP BY a, b, f, c), "
    "r1 AS (SELECT a, b, f, support, predicted, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS prec, "
    "CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rec FROM pc), "
    "rep AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM r1), "
    "acc AS (SELECT a, b, f, sum(CASE WHEN y = p THEN n ELSE 0 END) / sum(n) AS accuracy FROM conf GROUP BY a, b, f), "
    "mf AS (SELECT a, b, f, avg(CASE WHEN support > 0 OR predicted > 0 THEN f1 END) AS macro_f1 FROM rep GROUP BY a, b, f), "
    "fm AS (SELECT a, b, f, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM acc JOIN mf USING (a, b, f)), "
    "runs AS (SELECT g.run_id, g.use_hf_train_extra, g.merge_hard_examples, g.confidence_fallback_enabled, fm.accuracy, fm.macro_f1 "
    "FROM grid g JOIN fm ON g.confidence_fallback_enabled = fm.f AND g.use_hf_train_extra = fm.a AND g.merge_hard_examples = fm.b)\n"
    "SELECT o.use_hf_train_extra, o.merge_hard_examples, o.run_id AS run_off, o.accuracy AS accuracy_off, "
    "o.macro_f1 AS macro_f1_off, n.run_id AS run_on, n.accuracy AS accuracy_on, n.macro_f1 AS macro_f1_on, "
    "n.accuracy - o.accuracy AS delta_accuracy, n.macro_f1 - o.macro_f1 AS delta_macro_f1, "
    "(n.accuracy - o.accuracy = 0) AND (n.macro_f1 - o.macro_f1 = 0) AS no_change "
    "FROM runs o JOIN runs n ON o.use_hf_train_extra = n.use_hf_train_extra AND o.merge_hard_examples = n.merge_hard_examples "
    "WHERE NOT o.confidence_fallback_enabled AND n.confidence_fallback_enabled")


@register("ablation_pairs", _PAIRS_SQL, ("J9",))
def ablation_pairs_q(spark, d):
    counts = pool_label_counts(spark, d)
    path = scratch_path(spark, "pool_counts")
    counts.write.parquet(path)  # four rows that the grid and the priors read
    counts = spark.read.parquet(path)
    sizes = counts.select("use_hf_train_extra", "merge_hard_examples", (F.col("n0") + F.col("n1") + F.col("n2")).alias("train_pool_size"))
    runs = EX.ablation_grid(sizes).join(
        _pool_metrics(spark, d, counts), ["use_hf_train_extra", "merge_hard_examples", "confidence_fallback_enabled"])
    return EX.ablation_pairs(runs)
