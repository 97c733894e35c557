"""Exact positions and seeded ranks without a single-partition window.

Both helpers follow the same two-step idea as ``zipWithIndex``: count rows per
small "slot" (an input partition, or a hash bucket within a group), turn the
tiny count table into offsets, and add a slot-local row number.  The only
global step runs on the count table, whose size is bounded by the number of
slots — never by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpool.functions.hashing import hex_bucket, seeded_hex

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id in the upper 31 bits


def default_buckets(spark, floor: int = 64, cap: int = 1 << 16) -> int:
    """Hash buckets per group: scales with the cluster's shuffle parallelism."""
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:
        n = 200
    return max(floor, min(cap, 4 * n))


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """0-based position in input order: by file path, place in the file, line.

    Apply directly on a deterministic source. A file scan packs pieces of
    files into partitions by size, so the order comes from the pieces' own
    path and start, not from partition numbers; a frame that is no file scan
    is ordered by partition. The position of a row is the same on every
    recomputation, so lost executors are safe.
    """
    try:
        slot = ["_path", "_start"]
        tagged = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    except AnalysisException:
        slot = ["_pid"]
        tagged = df.withColumn("_pid", F.spark_partition_id())
    tagged = tagged.withColumn("_mid", F.monotonically_increasing_id())
    # one row per piece of the input: bounded by the number of file splits
    counts = tagged.groupBy(*slot).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy(*slot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*slot, "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (
        tagged.join(offsets, slot, "inner")
        .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("long"))
        .drop("_mid", "_first", "_off", *slot)
    )


def with_seeded_rank(df: DataFrame, seed: int, key_cols: Sequence[str], group_cols: Sequence[str] = (),
                     name: str = "_rank", n_buckets: int | None = None) -> DataFrame:
    """0-based rank of each row within ``group_cols`` ordered by ``md5(seed || keys)``, then keys.

    ``group_cols`` must have a small, known cardinality (e.g. the 3 classes):
    the offset table has ``groups × n_buckets`` rows and is broadcast.
    Work per task is one bucket of one group, i.e. ``n / (groups · n_buckets)``
    rows on average; md5 spreads hot text values, ties are broken by the keys.
    """
    spark = df.sparkSession
    nb = n_buckets or default_buckets(spark)
    g = list(group_cols)
    h = seeded_hex(seed, *key_cols)
    tagged = df.withColumn("_h", h).withColumn("_b", hex_bucket(F.col("_h"), nb))
    counts = tagged.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if g \
        else Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*g, "_b", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    w_loc = Window.partitionBy(*g, "_b").orderBy("_h", *key_cols)
    ranked = tagged.withColumn("_loc", F.row_number().over(w_loc))
    return (
        ranked.join(F.broadcast(offsets), [*g, "_b"], "inner")  # size: groups × n_buckets
        .withColumn(name, (F.col("_off") + F.col("_loc") - 1).cast("long"))
        .drop("_h", "_b", "_loc", "_off")
    )


def _rank_range_partitions(ranged: DataFrame, name: str, materialise: bool) -> DataFrame:
    """Global 0-based rank of range-partitioned, locally sorted rows.

    A row's rank is the number of rows in earlier range partitions (a count
    table with one row per partition, broadcast) plus its local index.  With
    ``materialise`` the rows are written once with a reliable ``checkpoint()``
    in the shared folder, for inputs whose recomputation could differ.
    """
    spark = ranged.sparkSession
    ranged = ranged.withColumn("_mid", F.monotonically_increasing_id()) \
        .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS)) \
        .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
    if materialise:
        from textpool.session import checkpoint_root
        checkpoint_root(spark)
        ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (
        ranged.join(F.broadcast(offsets), "_pid", "inner")  # size: number of range partitions
        .withColumn(name, (F.col("_off") + F.col("_loc")).cast("long"))
        .drop("_mid", "_pid", "_loc", "_off")
    )


def with_sorted_rank(df: DataFrame, seed: int, key_cols: Sequence[str], name: str = "_rank",
                     n_parts: int | None = None) -> DataFrame:
    """0-based global rank ordered by ``md5(seed || keys)``, keys — safe for hot keys.

    Rows are range-partitioned on (md5, keys, u) where ``u`` is a seeded random
    tie-breaker, so even a key holding a third of all rows is cut across many
    tasks (identical rows are interchangeable, so ``u`` never changes the result).
    The tagged rows are materialised once with a reliable ``checkpoint()`` in
    the shared checkpoint folder, so the count pass and the rank pass read the
    same rows (the random tie-breaker is never re-drawn, even after executor loss).
    """
    spark = df.sparkSession
    n = n_parts or default_buckets(spark, floor=8, cap=1 << 15)
    keys = list(key_cols)
    tagged = df.withColumn("_h", seeded_hex(seed, *keys)).withColumn("_u", F.rand(seed))
    order = ["_h", *keys, "_u"]
    ranged = tagged.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return _rank_range_partitions(ranged, name, materialise=True).drop("_h", "_u")


def with_order_rank(df: DataFrame, order: Sequence[Column], name: str = "_rank",
                    n_parts: int | None = None) -> DataFrame:
    """0-based global rank under a *total* order (its keys are unique), with no single-task sort.

    Range-partitioned on the order and sorted within partitions.  The range
    bounds come from a sample of rows whose arrival order after a shuffle is
    not fixed, so two evaluations may cut the partitions differently: the
    ranked rows are materialised once (reliable checkpoint) and the count and
    rank passes both read them.
    """
    n = n_parts or default_buckets(df.sparkSession, floor=8, cap=1 << 15)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return _rank_range_partitions(ranged, name, materialise=True)


# Largest k served by a single-task top-k (TakeOrderedAndProject): every
# partition sends its local top-k to one task, i.e. partitions × k rows.
TOPK_SINGLE_TASK_LIMIT = 10_000


# Buckets per doubling of a count score: a bucket spans a factor 2^(1/16) ≈ 1.044.
_LOG_STEPS = 16


def _count_bucket(score: Column) -> Column:
    """Monotone bucket of a non-negative score: -1 for ≤ 0, else floor(16 · log2(score))
    (at most about 1,000 distinct values for any 64-bit count)."""
    return F.when(score > 0, F.floor(F.log2(score.cast("double")) * _LOG_STEPS)).otherwise(F.lit(-1)).cast("int")


def top_k(df: DataFrame, k: int, order: Sequence[Column], rank_col: str | None = None,
          n_parts: int | None = None, single_task_limit: int | None = None,
          desc_count: str | None = None) -> DataFrame:
    """Exactly the first ``k`` rows under a total ``order``; optionally their 0-based rank.

    Small ``k``: TakeOrderedAndProject (and, for the rank, a window over those
    ≤ k rows).  Large ``k``: a range-partitioned global rank and a filter, so
    no task receives ``partitions × k`` rows.

    ``desc_count`` names a non-negative count column that is the first,
    descending order key.  Rows are then counted per log-scale bucket of it
    (≈ 1,000 buckets, partially aggregated), a scalar subquery finds the bucket
    where the running count from the top reaches ``k``, and only rows at or
    above it (about ``1.05 · k`` for frequency-like counts) are ranked and
    materialised — not every row.
    """
    limit = TOPK_SINGLE_TASK_LIMIT if single_task_limit is None else single_task_limit
    order = list(order)
    if k <= limit:
        top = df.orderBy(*order).limit(k)
        if rank_col:
            top = top.withColumn(rank_col, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
        return top
    if desc_count:
        b = _count_bucket(F.col(desc_count))
        hist = df.select(b.alias("_lb")).groupBy("_lb").agg(F.count(F.lit(1)).alias("_n"))  # ≤ ~1,000 rows
        running = F.sum("_n").over(Window.orderBy(F.desc("_lb")).rowsBetween(Window.unboundedPreceding, 0))
        cut = hist.select("_lb", running.alias("_cum")).filter(F.col("_cum") >= k) \
            .agg(F.max("_lb").alias("_cut")).scalar()  # null when k ≥ count: keep every row
        df = df.filter(b >= F.coalesce(cut, F.lit(-1)))
        # about k candidates: size the range partitions by k, not by the input
        n_parts = n_parts or min(default_buckets(df.sparkSession, floor=8, cap=1 << 15), max(8, -(-k // 10_000)))
    name = rank_col or "_topk_rank"
    ranked = with_order_rank(df, order, name, n_parts).filter(F.col(name) < k)
    return ranked if rank_col else ranked.drop(name)
