"""Embedding near-dedup with an inverted multi-index.

Two codebooks, one per half of the vectors, form a product grid of cells. A
vector lies in the cell of its nearest codewords and looks for partners in the
cells nearest to it, visited in order of distance (multi-sequence traversal)
up to a radius that is calibrated for a target recall. Cells are compared in
blocks of bounded size as matrix products; every pair found is verified
exactly, and only counts and a spanning forest of the links leave a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpool.llm.common import connected, materialise

THRESHOLD = 0.93
#: Bound of the sample on which codebooks and radius are fitted.
FIT_ROWS = 20_000
#: Share of the pairs of the sample, and of pairs made at random at and above the threshold, within the radius.
TARGET_RECALL = 0.995
#: Vectors per cell that the number of codewords aims at.
PER_CELL = 32
ROUNDS = 12
#: Rows and columns of a block that one task compares at once.
BLOCK = 512


@dataclass
class MultiIndex:
    """Codebooks of the two halves and the radius, by dimension of the vectors."""

    books: dict[int, tuple[np.ndarray, np.ndarray]]
    radius: dict[int, float]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each row's halves to the codewords, rounded so that all uses agree."""
        half = x.shape[1] // 2
        return tuple(np.round(np.maximum(((p * p).sum(1)[:, None] - 2 * p @ w.T + (w * w).sum(1)), 0), 9)
                     for p, w in zip((x[:, :half], x[:, half:]), self.book(x.shape[1]), strict=True))

    def book(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """A dimension that the sample did not hold has one cell."""
        return self.books.get(dim) or (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))

    def reach(self, dim: int) -> float:
        return self.radius.get(dim, 0.0)


def traverse(d1: np.ndarray, d2: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """Cells by increasing d1[i] + d2[j] up to ``radius`` above the nearest: the multi-sequence walk on both sorted lists."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    most = s1[0] + s2[0] + radius
    out, heap, seen = [], [(s1[0] + s2[0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= most:
        _, a, b = heapq.heappop(heap)
        out.append((int(o1[a]), int(o2[b])))
        for p, q in ((a + 1, b), (a, b + 1)):
            if p < len(s1) and q < len(s2) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (s1[p] + s2[q], p, q))
    return out


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = ((words * words).sum(1) - 2 * x @ words.T).argmin(1)
        size = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words[size > 0] = total[size > 0] / size[size > 0, None]
    return words


def fit(sample: list[tuple[int | None, np.ndarray]], n: int, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> MultiIndex:
    """The index for ``n`` vectors from a sample of (label, unit vector)."""
    index = MultiIndex({}, {})
    rng = np.random.default_rng(7)
    for dim in sorted({len(v) for _, v in sample if len(v) > 1}):
        own = [(label, v) for label, v in sample if len(v) == dim]
        x = np.array([v for _, v in own])
        labels = np.array([label for label, _ in own])
        k = max(1, min(len(x) // 8, int(np.ceil(np.sqrt(n / PER_CELL)))))
        index.books[dim] = _codebook(x[:, :dim // 2], k, rng), _codebook(x[:, dim // 2:], k, rng)
        d1, d2 = index.distances(x)
        base = d1.min(1) + d2.min(1)
        home = d1.argmin(1), d2.argmin(1)
        excess = []
        for label in np.unique(labels):
            at = np.flatnonzero(labels == label)
            for a in range(0, len(at), 1024):
                rows = at[a:a + 1024]
                p, q = np.nonzero(x[rows] @ x[at].T >= threshold)
                p, q = rows[p], at[q]
                p, q = p[p < q], q[p < q]
                there = d1[p, home[0][q]] + d2[p, home[1][q]] - base[p]
                back = d1[q, home[0][p]] + d2[q, home[1][p]] - base[q]
                excess.append(np.minimum(there, back))
        # made pairs: each vector turned towards a random direction, to a cosine between the threshold and 1
        turn = rng.normal(size=x.shape)
        turn -= (turn * x).sum(1)[:, None] * x
        turn /= np.maximum(np.linalg.norm(turn, axis=1), 1e-12)[:, None]
        c = rng.uniform(threshold, 1, len(x))[:, None]
        y = c * x + np.sqrt(1 - c * c) * turn
        e1, e2 = index.distances(y)
        i, j = e1.argmin(1), e2.argmin(1)
        rows = np.arange(len(x))
        there = d1[rows, i] + d2[rows, j] - base
        back = e1[rows, home[0]] + e2[rows, home[1]] - e1.min(1) - e2.min(1)
        made = np.minimum(there, back)
        found = np.concatenate(excess) if excess else np.zeros(0)
        index.radius[dim] = float(max(np.quantile(made, target), np.quantile(found, target) if len(found) else 0.0)) + 1e-6
    return index


_VECTOR = "f long, label long, dim int, vec binary, copies long, c1 int, c2 int, probes array<struct<i:int,j:int>>"


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MultiIndex(**shared.value)
        for batch in batches:
            vectors = [np.array(v, float) for v in batch.column("embedding").to_pylist()]
            dims = np.array([len(v) for v in vectors])
            out = {c: [None] * len(vectors) for c in ("vec", "c1", "c2", "probes")}
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _unit(np.array([vectors[i] for i in at]))
                d1, d2 = index.distances(x)
                for n, i in enumerate(at.tolist()):
                    cells = traverse(d1[n], d2[n], index.reach(dim))
                    out["vec"][i], (out["c1"][i], out["c2"][i]) = x[n].tobytes(), cells[0]
                    out["probes"][i] = [{"i": a, "j": b} for a, b in cells]
            cell = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("f"), batch.column("label"), pa.array(dims.astype(np.int32)), pa.array(out["vec"], pa.binary()), batch.column("copies"),
                 pa.array(out["c1"], pa.int32()), pa.array(out["c2"], pa.int32()), pa.array(out["probes"], cell)],
                ["f", "label", "dim", "vec", "copies", "c1", "c2", "probes"])
    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(shared, threshold: float):
    """Rows (key, asks, f, vec, dim, copies, c1, c2, own) sorted by key: rows (f, links, root) of each block.

    ``own``: the cell of the block is the asking vector's home. A link found
    from one side counts for that side, and for the other too unless the other
    finds it itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MultiIndex(**shared.value)
        key, held = None, []

        def close() -> pa.RecordBatch:
            asks, here = [r for r in held if r[1]], [r for r in held if not r[1]]
            none = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["f", "links", "root"])
            if not asks or not here:
                return none
            x, y = (np.frombuffer(b"".join(r[3] for r in rows), float).reshape(len(rows), -1) for rows in (asks, here))
            fx, fy = (np.array([r[2] for r in rows]) for rows in (asks, here))
            hit = (x @ y.T >= threshold) & (fx[:, None] != fy[None, :])
            if not hit.any():
                return none
            cx, cy = (np.array([r[5] for r in rows]) for rows in (asks, here))
            links_x = (hit * cy[None, :]).sum(1)
            p, q = np.nonzero(hit & ~np.array([r[8] for r in asks], bool)[:, None])
            links_y = np.zeros(len(here), np.int64)
            if len(p):
                d1, d2 = index.distances(y)
                to = np.array([r[6] for r in asks])[p], np.array([r[7] for r in asks])[p]
                unseen = d1[q, to[0]] + d2[q, to[1]] > d1.min(1)[q] + d2.min(1)[q] + index.reach(y.shape[1])
                np.add.at(links_y, q[unseen], cx[p[unseen]])
            # a forest: the smallest class that the links of this block join to
            far = np.iinfo(np.int64).max
            root_y = fy.copy()
            root_x = fx.copy()
            while True:
                new_x = np.minimum(root_x, np.where(hit, root_y[None, :], far).min(1))
                new_y = np.minimum(root_y, np.where(hit, new_x[:, None], far).min(0))
                if (new_x == root_x).all() and (new_y == root_y).all():
                    break
                root_x, root_y = new_x, new_y
            any_x, any_y = hit.any(1), hit.any(0)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.r_[fx[any_x], fy[any_y]]), pa.array(np.r_[links_x[any_x], links_y[any_y]].astype(np.int64)),
                 pa.array(np.r_[root_x[any_x], root_y[any_y]])], ["f", "links", "root"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key and held:
                    yield close()
                    held = []
                key = row[0]
                held.append(row)
        if held:
            yield close()
    return run


def _label(vectors: DataFrame) -> Column:
    """The label as a long: whole numbers as they are, any other type by its hash; null stays null."""
    if isinstance(vectors.schema["label"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col("label").cast("long")
    return F.when(F.col("label").isNotNull(), F.xxhash64("label"))


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS,
                 target: float = TARGET_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors(vec_id, embedding, label)``.

    Labels may be of any type that can be hashed. Two vectors link when their
    labels are equal and not null, their lengths
    are equal and their cosine, in double precision, is ``threshold`` or more.
    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing. Equal vectors of one label are one class, whose rows
    all link. Links below the threshold are never reported; above it, those
    within the calibrated radius are found. Rows without a vec_id take part
    and are kept only if nothing else is in their component. An empty table
    gives an empty result.
    """
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), _label(vectors).alias("label"))
    fine = (F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
            & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists("embedding", lambda v: v != 0))
    rows = materialise(spark, own.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn(
        "f", F.when(F.col("fine"), F.xxhash64("label", "embedding"))), "vectors")
    classes = materialise(spark, rows.filter("fine").groupBy("f").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"),
        F.min("vec_id").alias("least")), "vector-classes")
    n = classes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.select("label", "embedding", F.xxhash64("f").alias("h"))
    if n > fit_rows:  # an even part by hash, then at most fit_rows of it
        sample = sample.filter(F.pmod(F.col("h"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * fit_rows / n)))
    table = sample.orderBy("h").limit(fit_rows).toArrow()  # in this order the index does not depend on the rows'
    index = fit([(label, _unit(np.array([v]))[0]) for label, v in zip(table["label"].to_pylist(), table["embedding"].to_pylist(), strict=True)],
                n, threshold, target)
    shared = spark.sparkContext.broadcast(vars(index))  # plain arrays: a worker may not have this package
    placed = materialise(spark, classes.select("f", "label", "embedding", "copies").mapInArrow(_assign(shared), _VECTOR), "vector-cells")
    cell = ["label", "dim", "c1", "c2"]
    members = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("members"))
    asks = (placed.select("f", "label", "dim", F.col("c1").alias("h1"), F.col("c2").alias("h2"), F.explode("probes").alias("p"))
            .select("f", "label", "dim", "h1", "h2", F.col("p.i").alias("c1"), F.col("p.j").alias("c2")).join(members.select(*cell), cell))
    asks = materialise(spark, asks, "vector-probes")
    sizes = members.join(asks.groupBy(*cell).agg(F.count(F.lit(1)).alias("askers")), cell).select(
        *cell, F.ceil(F.col("members") / BLOCK).cast("int").alias("m_blocks"), F.ceil(F.col("askers") / BLOCK).cast("int").alias("q_blocks"))
    sizes = materialise(spark, sizes, "vector-blocks")

    def blocks(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def part(count: str):
        return F.pmod(F.xxhash64("f"), F.col(count)).cast("int")

    key = F.xxhash64(*cell, "m", "q").alias("key")
    vec = placed.select("f", "vec", "copies", F.col("c1").alias("home1"), F.col("c2").alias("home2"))
    here = placed.join(sizes, cell).withColumn("m", part("m_blocks")).withColumn("q", blocks("q_blocks")).select(
        key, F.lit(False).alias("asks"), "f", "vec", "dim", "copies", "c1", "c2", F.lit(True).alias("own"))
    asking = asks.join(sizes, cell).withColumn("q", part("q_blocks")).withColumn("m", blocks("m_blocks")).select(
        key, F.lit(True).alias("asks"), "f", "dim", F.expr("h1 = c1 AND h2 = c2").alias("own"))
    asking = asking.join(vec, "f").select("key", "asks", "f", "vec", "dim", "copies", F.col("home1").alias("c1"), F.col("home2").alias("c2"), "own")
    found = here.union(asking).repartition("key").sortWithinPartitions("key").mapInArrow(
        _compare(shared, threshold), "f long, links long, root long")
    found = materialise(spark, found, "vector-links")
    roots = connected(spark, found.select(F.col("f").alias("u"), F.col("root").alias("v")), "vector-roots")
    links = found.groupBy("f").agg(F.sum("links").alias("links"))
    named = (classes.select("f", "copies", "least").join(links, "f", "left")
             .join(roots.withColumnRenamed("node", "f"), "f", "left")
             .select("f", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least", F.coalesce("root", "f").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    result = named.join(least, "root").select("f", "n_links", "component_id")
    linked = rows.filter("fine").join(result, "f").select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))
    return linked.union(rows.filter("NOT fine").select("vec_id", F.lit(0).cast("long"), "vec_id", F.lit(True)))
