"""Experiment analytics: ablation grid and pairs, epoch selection, seed variance."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Early-stopping defaults and the plan's note.
PATIENCE = 2
MIN_DELTA = 1e-4
PLAN_NOTE = "Train + evaluate required for fair comparison."

_EPOCH = "epoch int, train_loss double, val_loss double, val_macro_f1 double"


def ablation_grid(pool_configs: DataFrame) -> DataFrame:
    """The 2³ plan from rows of (use_hf_train_extra, merge_hard_examples, ...).

    Each pool-config row is expanded with both fallback settings by ``explode``
    (a generator, not a join); the run number is ``4a + 2b + c + 1``.
    """
    g = pool_configs.withColumn("confidence_fallback_enabled", F.explode(F.array(F.lit(False), F.lit(True))))
    n = (F.col("use_hf_train_extra").cast("int") * 4 + F.col("merge_hard_examples").cast("int") * 2
         + F.col("confidence_fallback_enabled").cast("int") + 1)
    return g.select(
        F.format_string("abl_%02d", n).alias("run_id"), "*",
        (F.col("use_hf_train_extra") | F.col("merge_hard_examples")).alias("requires_retrain"),
        F.lit(PLAN_NOTE).alias("notes"),
    )


def ablation_pairs(runs: DataFrame, metrics=("accuracy", "macro_f1")) -> DataFrame:
    """Pair runs that differ only in the fallback flag; metric deltas and a no-change flag."""
    keys = ["use_hf_train_extra", "merge_hard_examples"]
    off = runs.filter(~F.col("confidence_fallback_enabled")).select(
        *keys, F.col("run_id").alias("run_off"), *[F.col(m).alias(f"{m}_off") for m in metrics])
    on = runs.filter(F.col("confidence_fallback_enabled")).select(
        *keys, F.col("run_id").alias("run_on"), *[F.col(m).alias(f"{m}_on") for m in metrics])
    j = off.join(on, keys, "inner")
    for m in metrics:
        j = j.withColumn(f"delta_{m}", F.col(f"{m}_on") - F.col(f"{m}_off"))
    no_change = F.lit(True)
    for m in metrics:
        no_change = no_change & (F.col(f"delta_{m}") == 0)
    return j.withColumn("no_change", no_change)


def select_epochs(history: DataFrame, patience: int = PATIENCE, min_delta: float = MIN_DELTA,
                  early_stopping: bool = True) -> DataFrame:
    """Replay the checkpoint / early-stopping rule per run.

    ``improved = f1 > best + min_delta``; a stale counter stops the run after
    ``patience`` non-improving epochs. Because of ``min_delta`` this is a fold,
    not a running max: rows are sorted by run and epoch, and the state (run,
    best, stale, stopped) is carried along them, so a run may have any number
    of epochs. An F1 that is null or NaN improves nothing. Returns only the
    epochs that ran, with ``improved``.
    """
    run_type = history.schema["run_id"].dataType.simpleString()
    rows = history.select("run_id", *[F.col(c.split()[0]).cast(c.split()[1]) for c in _EPOCH.split(", ")])
    order = ["run_id", "epoch", "train_loss", "val_loss", "val_macro_f1"]
    ranged = rows.repartition("run_id").sortWithinPartitions(*order)

    def fold(batches):
        at, best, stale, stopped, begun = None, -1.0, 0, False, False
        for batch in batches:
            ran, improved = [], []
            for run, f1 in zip(batch.column("run_id").to_pylist(), batch.column("val_macro_f1").to_pylist(), strict=True):
                if run != at or not begun:
                    at, best, stale, stopped, begun = run, -1.0, 0, False, True
                better = f1 is not None and f1 > best + min_delta
                ran.append(not stopped)
                improved.append(better)
                if not stopped:
                    best, stale = (f1, 0) if better else (best, stale + 1)
                    stopped = early_stopping and stale >= patience
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(improved, pa.bool_())], [*batch.schema.names, "improved"]) \
                .filter(pa.array(ran, pa.bool_()))

    return ranged.mapInArrow(fold, f"run_id {run_type}, {_EPOCH}, improved boolean")


def best_checkpoint(epochs: DataFrame) -> DataFrame:
    """Last improved epoch per run, its F1, epochs that ran, and whether the run stopped early."""
    return epochs.groupBy("run_id").agg(
        F.max(F.when(F.col("improved"), F.col("epoch"))).alias("best_epoch"),
        F.max(F.when(F.col("improved"), F.col("val_macro_f1"))).alias("best_val_macro_f1"),
        F.count(F.lit(1)).alias("epochs_ran"),
    )


def seed_variance(runs: DataFrame, group_col: str) -> DataFrame:
    """Mean ± population std of the best validation macro-F1 over valid runs, per group.

    Runs without a (truthy) F1 are ignored; a group without valid runs yields nulls.
    """
    valid = F.when(F.col("best_val_macro_f1") > 0, F.col("best_val_macro_f1"))
    return runs.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count(valid).alias("valid_runs"),
        F.avg(valid).alias("mean_val_macro_f1"),
        F.stddev_pop(valid).alias("std_val_macro_f1"),
        F.avg("epochs_ran").alias("mean_epochs"),
    )


def experiment_artifacts(epochs: DataFrame, sizes: DataFrame, config: dict, runtime: dict, model_name: str, model_path: str,
                         class_names: list[str]) -> DataFrame:
    """K2: one nested row per run: its sizes, the settings, the best F1 and the history of the epochs that ran.

    ``epochs`` are rows of ``select_epochs``, ``sizes(run_id, train, val)``. A
    run's history is an array in its artifact, so it is bounded by the epochs
    that a training runs.
    """
    fixed = lambda d: F.struct(*[F.lit(v).alias(k) for k, v in d.items()])
    entry = F.struct("epoch", "train_loss", "val_loss", "val_macro_f1", "improved")
    runs = epochs.groupBy("run_id").agg(
        F.max(F.when(F.col("improved"), F.col("val_macro_f1"))).alias("best_val_macro_f1"),
        F.count(F.lit(1)).cast("int").alias("epochs_ran"), F.array_sort(F.collect_list(entry)).alias("epoch_history"))
    return runs.join(sizes, "run_id", "left").select(
        "run_id", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at_utc"),
        F.lit(model_name).alias("model_name"), F.lit(model_path).alias("model_path"), F.array(*map(F.lit, class_names)).alias("class_names"),
        F.struct("train", "val").alias("dataset_sizes"), fixed(runtime).alias("runtime"), fixed(config).alias("config_snapshot"),
        F.coalesce("best_val_macro_f1", F.lit(-1.0)).alias("best_val_macro_f1"), "epochs_ran", "epoch_history")


def multi_seed_summary(runs: DataFrame, group_col: str) -> DataFrame:
    """K2: per group (seed long, run_name, best_val_macro_f1, epochs) rows nested: seeds, results, mean and population std.

    Runs without a (truthy) F1 are listed but not averaged. A group is one
    multi-seed job, so its array is bounded by the seeds that it was given.
    """
    valid = F.when((F.col("best_val_macro_f1") != 0) & ~F.isnan("best_val_macro_f1"), F.col("best_val_macro_f1"))
    result = F.struct("seed", "run_name", "best_val_macro_f1", "epochs")
    found = runs.groupBy(group_col).agg(F.array_sort(F.collect_list(result)).alias("results"),
                                        F.avg(valid).alias("mean_val_macro_f1"), F.stddev_pop(valid).alias("std_val_macro_f1"))
    return found.select(group_col, F.transform("results", lambda r: r["seed"]).alias("seeds"), "results", "mean_val_macro_f1", "std_val_macro_f1")
