"""Training-pool assembly: union, majority dedup, overrides, leakage, splits, samples.

Shuffle budget per operator (all keyed, all with map-side partial aggregation):

* majority dedup — one shuffle on ``Sentence``; a sentence holding a third of
  all rows is pre-aggregated per map task into three counters.
* override merge, leakage removal — one anti join on a 32-byte digest of the
  normalised key; counts of keys and overlaps move digests only.
* leakage report / overlap — one shuffle of ``(key, side)`` with partial agg.

A pool that is only counted goes through :func:`keyed` first: its texts are
replaced by digests at the scan, and every operator here works on them alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from textpool.functions.aggregates import count_where
from textpool.functions.hashing import digest
from textpool.functions.text import norm_join_key
from textpool.operators.ranking import with_seeded_rank, with_sorted_rank

SEED = 42
#: Digest of the normalised text, carried by keyed pools.
NORM_DIGEST = "_norm_digest"


def keyed(df: DataFrame) -> DataFrame:
    """A contract pool with digests for texts: ``Sentence`` (exact text), normalised text, ``Polarity``.

    Equal texts have equal digests, so dedup, overrides, leakage and all counts
    come out as on the texts, while a row in a shuffle is 64 bytes and a label.
    """
    return df.select(digest(F.col("Sentence")).alias("Sentence"),
                     digest(norm_join_key("Sentence")).alias(NORM_DIGEST), "Polarity")


def _norm_digest(df: DataFrame) -> Column:
    return F.col(NORM_DIGEST) if NORM_DIGEST in df.columns else digest(norm_join_key("Sentence"))


# ── J1 / A1 ────────────────────────────────────────────────────────────────
def union_pools(*pools: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), pools)


def majority_dedup(df: DataFrame) -> DataFrame:
    """A1: one row per exact ``Sentence`` with its majority label; smallest label on ties.

    Polarity is 0/1/2 by contract, so the vote is three conditional counts in a
    single aggregation (partial agg before the shuffle, no second shuffle).
    """
    key = [c for c in ("Sentence", NORM_DIGEST) if c in df.columns]
    agg = df.groupBy(*key).agg(
        count_where(F.col("Polarity") == 0).alias("_c0"),
        count_where(F.col("Polarity") == 1).alias("_c1"),
        count_where(F.col("Polarity") == 2).alias("_c2"),
    )
    vote = (
        F.when((F.col("_c0") >= F.col("_c1")) & (F.col("_c0") >= F.col("_c2")), F.lit(0))
        .when(F.col("_c1") >= F.col("_c2"), F.lit(1))
        .otherwise(F.lit(2))
        .cast("int")
    )
    return agg.select(*key, vote.alias("Polarity"))


def label_distribution(df: DataFrame, label_col: str = "Polarity") -> DataFrame:
    """A2: rows per label."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))


# ── J2 / J3 ────────────────────────────────────────────────────────────────
def merge_overrides(base: DataFrame, hard: DataFrame) -> DataFrame:
    """Curated rows replace base rows with the same normalised text, then are appended.

    Every base row whose ``lower().strip()`` key appears among the curated keys
    is removed (so all case variants go), then the curated rows are added.
    """
    hard_keys = hard.select(_norm_digest(hard).alias("_nk")).distinct()
    kept = base.withColumn("_nk", _norm_digest(base)).join(hard_keys, "_nk", "left_anti").drop("_nk")
    return kept.unionByName(hard.select(*base.columns))


def override_counts(base: DataFrame, hard: DataFrame) -> DataFrame:
    """Hard rows, overrides (hard rows whose key exists in base), new rows, pool sizes.

    One shuffle on the normalised key; the final one-row aggregate is global.
    """
    tagged = base.select(_norm_digest(base).alias("_nk"), F.lit(1).alias("_b"), F.lit(0).alias("_h")) \
        .unionByName(hard.select(_norm_digest(hard).alias("_nk"), F.lit(0).alias("_b"), F.lit(1).alias("_h")))
    per_key = tagged.groupBy("_nk").agg(F.sum("_b").alias("nb"), F.sum("_h").alias("nh"))
    out = per_key.agg(
        F.sum("nh").cast("long").alias("hard_rows"),
        F.coalesce(F.sum(F.when(F.col("nb") > 0, F.col("nh"))), F.lit(0)).cast("long").alias("overrides"),
        F.coalesce(F.sum(F.when(F.col("nb") == 0, F.col("nh"))), F.lit(0)).cast("long").alias("new_rows"),
        F.sum("nb").cast("long").alias("pool_before"),
        (F.sum("nb") - F.coalesce(F.sum(F.when(F.col("nh") > 0, F.col("nb"))), F.lit(0)) + F.sum("nh"))
        .cast("long").alias("pool_after"),
    )
    return out.na.fill(0)


# ── J4 / J5 / J6 ───────────────────────────────────────────────────────────
def leakage_report(train: DataFrame, val: DataFrame, n_samples: int = 20) -> DataFrame:
    """train/val sizes, distinct normalised overlap, ratio of distinct val keys, samples.

    Output: train_size, val_size, overlap_count, overlap_ratio_of_val (4dp),
    overlap_samples (the ``n_samples`` smallest overlapping keys, sorted).

    Keys meet as digests; ``train`` may be a keyed pool.  Texts are read for
    the samples only: those of ``val`` whose digest overlaps.
    """
    tagged = train.select(_norm_digest(train).alias("_nk"), F.lit(1).alias("_t"), F.lit(0).alias("_v")) \
        .unionByName(val.select(_norm_digest(val).alias("_nk"), F.lit(0).alias("_t"), F.lit(1).alias("_v")))
    per_key = tagged.groupBy("_nk").agg(F.sum("_t").alias("nt"), F.sum("_v").alias("nv"))
    both = (F.col("nt") > 0) & (F.col("nv") > 0)
    # top-k of the overlap keys: TakeOrderedAndProject, bounded by n_samples
    texts = val.select(norm_join_key("Sentence").alias("_s")).withColumn("_nk", digest(F.col("_s")))
    samples = texts.join(per_key.filter(both).select("_nk"), "_nk", "left_semi") \
        .select("_s").distinct().orderBy("_s").limit(n_samples)
    stats_rows = per_key.select("nt", "nv", both.alias("_both"), F.lit(None).cast("string").alias("_s"))
    sample_rows = samples.select(F.lit(0).cast("long").alias("nt"), F.lit(0).cast("long").alias("nv"),
                                 F.lit(False).alias("_both"), "_s")
    agg = stats_rows.unionByName(sample_rows).agg(
        F.coalesce(F.sum("nt"), F.lit(0)).cast("long").alias("train_size"),
        F.coalesce(F.sum("nv"), F.lit(0)).cast("long").alias("val_size"),
        count_where("_both").cast("long").alias("overlap_count"),
        count_where(F.col("nv") > 0).alias("_val_distinct"),
        F.array_sort(F.collect_list("_s")).alias("overlap_samples"),
    )
    return agg.select(
        "train_size", "val_size", "overlap_count",
        F.round(F.col("overlap_count") / F.greatest(F.col("_val_distinct"), F.lit(1)), 4)
        .cast("double").alias("overlap_ratio_of_val"),
        "overlap_samples",
    )


def remove_leakage(train: DataFrame, val: DataFrame) -> DataFrame:
    """Drop every train row whose normalised key occurs in val (val is untouched)."""
    val_keys = val.select(_norm_digest(val).alias("_nk")).distinct()
    return train.withColumn("_nk", _norm_digest(train)).join(val_keys, "_nk", "left_anti").drop("_nk")


def split_overlap(train: DataFrame, val: DataFrame, test: DataFrame, col: str = "Sentence") -> DataFrame:
    """Pairwise exact overlap (distinct values) of three splits in one shuffle."""
    tagged = (
        train.select(digest(F.col(col)).alias("_k"), F.lit(1).alias("_s"))
        .unionByName(val.select(digest(F.col(col)).alias("_k"), F.lit(2).alias("_s")))
        .unionByName(test.select(digest(F.col(col)).alias("_k"), F.lit(4).alias("_s")))
    )
    per_key = tagged.groupBy("_k").agg(F.bit_or("_s").alias("m"))
    has = lambda bit: (F.col("m").bitwiseAND(F.lit(bit)) > 0)
    return per_key.agg(
        count_where(has(1) & has(2)).cast("long").alias("train_val_overlap"),
        count_where(has(1) & has(4)).cast("long").alias("train_test_overlap"),
        count_where(has(2) & has(4)).cast("long").alias("val_test_overlap"),
    )


def guard_splits(splits: DataFrame, col: str = "Sentence", split_col: str = "split") -> DataFrame:
    """J6 guard: ``splits``, as a plan that fails if two splits share a value of ``col``.

    The overlap is a scalar subquery of the same plan (digests and split names,
    one shuffle), so whatever job writes or reads the splits fails, naming
    ``col`` and the number of shared values. ``splits`` is read twice: give a
    written table.
    """
    held = splits.select(digest(F.col(col)).alias("_k"), F.col(split_col).alias("_s"))
    per_key = held.groupBy("_k").agg(F.min("_s").alias("_a"), F.max("_s").alias("_b"))
    shared = per_key.agg(count_where(F.col("_a") != F.col("_b"))).scalar()
    message = F.concat(F.lit(f"splits are not disjoint on {col}: "), shared.cast("string"), F.lit(" shared values"))
    return splits.filter(F.when(shared > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


# ── W2 ──────────────────────────────────────────────────────────────────────
def _largest_remainder(counts: DataFrame, n_col: str, total_col: str, draws_col: str, out: str) -> DataFrame:
    """Allocate ``draws`` over classes proportionally; remainders go to the
    largest fractional parts, ties to the smallest class id (exact integer math)."""
    w_all = Window.partitionBy(F.lit(1))
    floored = F.expr(f"({draws_col} * {n_col}) div {total_col}")
    rem = F.expr(f"({draws_col} * {n_col}) % {total_col}")
    c = counts.withColumn("_fl", floored).withColumn("_rem", rem)
    c = c.withColumn("_need", F.col(draws_col) - F.sum("_fl").over(w_all))
    w_rank = Window.partitionBy(F.lit(1)).orderBy(F.desc("_rem"), F.asc("Polarity"))
    c = c.withColumn("_ord", F.row_number().over(w_rank))
    return c.withColumn(out, (F.col("_fl") + F.when(F.col("_ord") <= F.col("_need"), 1).otherwise(0)).cast("long")) \
        .drop("_fl", "_rem", "_need", "_ord")


def split_quotas(df: DataFrame, test_size: float = 0.2, val_share: float = 0.5) -> DataFrame:
    """Per-class quotas of the two-step stratified split (≤ 3 rows; tiny windows)."""
    counts = df.groupBy("Polarity").agg(F.count(F.lit(1)).alias("n_c"))
    w_all = Window.partitionBy(F.lit(1))
    c = counts.withColumn("n", F.sum("n_c").over(w_all))
    c = c.withColumn("n_train", F.col("n") - F.ceil(F.col("n") * F.lit(test_size)).cast("long"))
    c = _largest_remainder(c, "n_c", "n", "n_train", "q_train")
    c = c.withColumn("t_c", F.col("n_c") - F.col("q_train")).withColumn("n_temp", F.sum("t_c").over(w_all))
    c = c.withColumn("n_val", F.col("n_temp") - F.ceil(F.col("n_temp") * F.lit(val_share)).cast("long"))
    c = _largest_remainder(c, "t_c", "n_temp", "n_val", "q_val")
    return c.select("Polarity", "n_c", "q_train", "q_val", (F.col("t_c") - F.col("q_val")).alias("q_test"))


def stratified_split(df: DataFrame, seed: int = SEED, test_size: float = 0.2, val_share: float = 0.5,
                     n_buckets: int | None = None) -> DataFrame:
    """Exact stratified 80/10/10 split of a sentence-level (deduplicated) pool.

    Sentences are unique after majority dedup, so md5 buckets are balanced;
    (a pool with repeated sentences should go through ``majority_dedup`` first,
    as the reference's split does).

    Within each class rows are ranked by ``md5(seed || Sentence)`` without a
    per-class window (bucketed ranks); the first ``q_train`` go to train, the
    next ``q_val`` to val, the rest to test.
    """
    quotas = split_quotas(df, test_size, val_share)
    ranked = with_seeded_rank(df, seed, ["Sentence"], ["Polarity"], n_buckets=n_buckets)
    joined = ranked.join(F.broadcast(quotas), "Polarity", "inner")  # ≤ 3 rows
    split = (
        F.when(F.col("_rank") < F.col("q_train"), F.lit("train"))
        .when(F.col("_rank") < F.col("q_train") + F.col("q_val"), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return joined.select("Sentence", "Polarity", split.alias("split"))


# ── W5 ──────────────────────────────────────────────────────────────────────
def seeded_sample(df: DataFrame, n: int, seed: int = SEED, key_cols: Sequence[str] = ("Sentence", "Polarity"),
                  n_buckets: int | None = None) -> DataFrame:
    """Exactly ``min(n, count)`` rows, chosen by ``md5(seed || keys)`` order.

    Rows are counted per md5-prefix bucket (a partially
    aggregated table of at most ``n_buckets`` rows).  Buckets are monotone in
    the md5 order, so every row of a bucket before the one where the running
    count reaches ``n`` is in the sample and no row after it is.  Only those
    candidates get the exact range-partitioned rank (no single-task sort; a
    hot key is cut across tasks by a random tie-breaker) and its checkpoint,
    i.e. about ``n`` rows instead of the whole input.  Identical rows tie, but
    they are indistinguishable, so the result is exact.
    """
    from textpool.functions.hashing import hex_bucket, seeded_hex
    from textpool.operators.ranking import default_buckets
    keys = list(key_cols)
    nb = n_buckets or default_buckets(df.sparkSession)
    bucket = hex_bucket(seeded_hex(seed, *keys), nb)
    counts = df.select(bucket.alias("_b")).groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # ≤ nb rows
    running = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    # scalar subquery (no driver round trip); null when n ≥ count, and then every row is a candidate
    cut = counts.select("_b", running.alias("_cum")).filter(F.col("_cum") >= n) \
        .agg(F.min("_b").alias("_cut")).scalar()
    candidates = df.filter(bucket <= F.coalesce(cut, F.lit(nb)))
    ranked = with_sorted_rank(candidates, seed, keys, n_parts=n_buckets)
    return ranked.filter(F.col("_rank") < n).drop("_rank")


# ── A5 / A6 ────────────────────────────────────────────────────────────────
def observed_write(df: DataFrame, path: str, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` and read it back, with metrics (``rows`` at least) that were observed in the same pass."""
    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def land_source(raw: DataFrame, path: str, label_col: str) -> dict:
    """Write a raw source as header CSV; its columns, rows and rows per class (``unlabelled``: none) of the same pass."""
    from textpool.functions.labels import polarity_of
    from textpool.sinks.writers import write_csv
    seen, cls = Observation("landing"), polarity_of(label_col, None)
    names = {"negative": cls == 0, "neutral": cls == 1, "positive": cls == 2, "unlabelled": cls.isNull()}
    write_csv(raw.observe(seen, F.count(F.lit(1)).alias("rows"), *[count_where(c).alias(k) for k, c in names.items()]), path)
    return {"columns": raw.columns, "rows": seen.get["rows"], "labels": {k: seen.get[k] for k in names}}


def class_weights(df: DataFrame, label_col: str = "Polarity", num_classes: int = 3,
                  neutral_index: int = 1, neutral_boost: float = 1.0) -> DataFrame:
    """``total / (k · max(count, 1))``, normalised to mean 1, neutral boost, normalised again.

    All ones for an empty input. Works on the ≤ k-row count table only.
    """
    spark = df.sparkSession
    counts = df.groupBy(F.col(label_col).alias("Polarity")).agg(F.count(F.lit(1)).alias("_n"))
    classes = spark.range(num_classes).select(F.col("id").cast("int").alias("Polarity"))
    c = classes.join(F.broadcast(counts), "Polarity", "left").na.fill(0, ["_n"])  # ≤ k rows
    w = Window.partitionBy(F.lit(1))
    c = c.withColumn("_tot", F.sum("_n").over(w))
    c = c.withColumn("_w0", F.when(F.col("_tot") == 0, F.lit(1.0)).otherwise(
        F.col("_tot") / (F.lit(float(num_classes)) * F.greatest(F.col("_n").cast("double"), F.lit(1.0)))))
    c = c.withColumn("_w1", F.col("_w0") / F.avg("_w0").over(w))
    c = c.withColumn("_w2", F.when(F.col("Polarity") == neutral_index, F.col("_w1") * F.lit(float(neutral_boost)))
                     .otherwise(F.col("_w1")))
    c = c.withColumn("weight", F.col("_w2") / F.avg("_w2").over(w))
    return c.select("Polarity", F.col("_n").cast("long").alias("count"), "weight")
