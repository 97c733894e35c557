"""N-gram Jaccard join of whole texts: classes of documents whose shingle sets overlap by three quarters or more.

Rows with equal sets are one class from the start. Then three steps, each on
what the one before could not settle:

1. Certify. A class with so many shingles of its own that no other set can
   reach the threshold links with nothing; that is the prefix filter with the
   rarest shingles first, where a prefix of unique shingles meets no partner.
   Uniqueness is counted over all documents, on a fixed part of the hash range.
2. Group. Of the rest, sets with the same least (then the same greatest) hash
   are compared with a few leaders each, which settles most of a large group
   of near copies in linear time. Only links that hold are kept.
3. Join. Shingles that still occur in two groups are ordered rare-first; the
   prefixes of the sets are joined on them, under the length and positional
   filters, for pairs of different groups only. Every remaining pair is
   verified once, after a suffix filter on hash ranges.

No step drops, caps or samples; the result is exact up to 64-bit hash collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpool.llm.common import connected, materialise
from textpool.llm.shingles import mix, shingle_sets

#: Part of the hash range on which step 1 counts. Any value gives the same result.
REGION = 0.4
_REGION_END = np.uint64(int(REGION * 2**64))
#: Postings per bucket of step 1, sets per group of step 2, pairs per part of step 3: what one task holds.
BUCKET, GROUP, PART = 2_000_000, 256, 4_000
LEAST_BUCKETS = 12
#: Up to so many uncertified classes travel to the tasks (8 bytes each) to pick their rows; beyond, a join picks them.
MOST_SHIPPED = 4_000_000
_RANGES = 64
#: Stands for the classes of a slab that share a token.
MARK = np.uint64(0)

_SET = "f long, n int, tokens binary"


def linked(n1: int, n2: int, common: int) -> bool:
    """100 * intersection >= 75 * union."""
    return 7 * common >= 3 * (n1 + n2)


def _fingerprints(h: np.ndarray, rows: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each row's hashes, n, fingerprint of the set) of rows first..last-1."""
    start = np.searchsorted(rows, np.arange(first, last + 1))
    n = np.diff(start)
    total = np.r_[np.uint64(0), np.cumsum(mix(h))]
    return start, n, mix(total[start[1:]] - total[start[:-1]] + n.astype(np.uint64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, h, rows in shingle_sets(batch.column(1)):
            start, n, f = _fingerprints(h, rows, first, last)
            inside = np.r_[0, np.cumsum(h < _REGION_END)]
            some = n > 0
            low, high = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            low[some], high[some] = h[start[:-1][some]], h[start[1:][some] - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), pa.array(f.view(np.int64), mask=~some), pa.array(n.astype(np.int64)),
                 pa.array((inside[start[1:]] - inside[start[:-1]]).astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
                 batch.column(2).slice(first, last - first)],
                ["doc_id", "f", "n", "n_region", "low", "high", "row_key"])


def describe(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, f (fingerprint of its set, null for an empty one), n, n_region, low, high (least and greatest hash), row_key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row_key().alias("row_key")).mapInArrow(
        _describe, "doc_id long, f long, n long, n_region long, low long, high long, row_key long")


def _row_key():
    """Hash of a row's id and text; never null."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


# step 1: postings (token, class) of the region, packed by bucket of the token. A token travels as its low 32 bits:
# two tokens of a bucket that agree in them count as shared, so a class may stay uncertified, never the reverse.
# A token that several classes of a slab hold is shared for certain: its bucket gets one posting of MARK, and the classes'
# own postings are dealt by class and bucket, so a shingle of a third of all classes is spread over all tasks. A class
# with copies in other slabs may have such a token counted on both ways; again it only stays uncertified.

def _pack(f: np.ndarray, runs: np.ndarray, tokens: np.ndarray) -> bytes:
    return b"".join((np.uint32(len(f)).tobytes(), f.tobytes(), runs.astype(np.uint32).tobytes(), tokens.astype(np.uint32).tobytes()))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = int(np.frombuffer(data, np.uint32, 1)[0])
    f, runs = np.frombuffer(data, np.uint64, k, 4), np.frombuffer(data, np.uint32, k, 4 + 8 * k)
    return np.repeat(f, runs), np.frombuffer(data, np.uint32, -1, 4 + 12 * k)


def _repeated(h: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    if len(h):
        out[order] = np.r_[False, same] | np.r_[same, False]
    return out


def _postings(n_buckets: int):
    """Rows (bucket, payload): tokens by their bucket; below zero, tokens known to be shared, dealt by class and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.uint64(int(_REGION_END) // n_buckets + 1)
        for batch in batches:
            for first, last, h, rows in shingle_sets(batch.column(0)):
                _, _, f = _fingerprints(h, rows, first, last)
                _, once = np.unique(f, return_index=True)  # copies within the slab count once
                chosen = np.zeros(last - first, bool)
                chosen[once] = True
                keep = (h < _REGION_END) & chosen[rows - first]
                h, own = h[keep], f[rows[keep] - first]
                bucket = (h // width).astype(np.int64)
                known = _repeated(h)
                marked = np.unique(h[known])
                dealt = n_buckets + ((mix(own[known]) + bucket[known].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
                bucket = np.concatenate([bucket[~known], (marked // width).astype(np.int64), dealt])
                own = np.concatenate([own[~known], np.full(len(marked), MARK), own[known]])
                h = np.concatenate([h[~known], marked, h[known]])
                order = np.argsort(bucket.astype(np.uint16) if 2 * n_buckets < 65536 else bucket, kind="stable")
                h, own, bucket = h[order], own[order], bucket[order]
                edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(h)] if len(h) else np.zeros(0, int)
                ids, payloads = [], []
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    part, b = slice(x, y), int(bucket[x])
                    at = np.flatnonzero(np.r_[True, own[part][1:] != own[part][:-1]])
                    ids.append(b if b < n_buckets else n_buckets - b - 1)
                    payloads.append(_pack(own[part][at], np.diff(np.r_[at, len(own[part])]), h[part]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])
    return run


def _count_shared(group: pa.Table) -> pa.Table:
    """(f, shared): of each class, its tokens in this bucket that another class holds too (below zero: all of them)."""
    parts = [_unpack(x.as_py()) for x in group.column("payload")]
    f, tokens = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((f, tokens))
    f, tokens = f[order], tokens[order]
    same = tokens[1:] == tokens[:-1]
    new = np.r_[True, ~same | (f[1:] != f[:-1])]
    f, tokens = f[new], tokens[new]
    if group.column("bucket")[0].as_py() >= 0:
        same = tokens[1:] == tokens[:-1]
        f = f[np.r_[False, same] | np.r_[same, False]]
    shared, count = np.unique(f[f != MARK], return_counts=True)
    return pa.table({"f": pa.array(shared.view(np.int64)), "shared": pa.array(count.astype(np.int64))})


def _prefix(n):
    """Length of a prefix that any linked set must meet: n - ceil(0.75 n) + 1."""
    return n - F.ceil(n * 3 / 4) + 1


def uncertified(spark: SparkSession, docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that have too few shingles of their own to be sure to link with nothing."""
    total = rows.agg(F.sum("n_region")).first()[0] or 0
    n_buckets = max(LEAST_BUCKETS, -(-total // BUCKET))
    packed = docs.select("text").mapInArrow(_postings(n_buckets), "bucket int, payload binary")
    shared = packed.groupBy("bucket").applyInArrow(_count_shared, "f long, shared long").groupBy("f").agg(F.sum("shared").alias("shared"))
    own = F.col("n_region") - F.coalesce("shared", F.lit(0))
    return classes.join(shared, "f", "left").filter(own < _prefix(F.col("n")))


# step 2: sets of the uncertified classes, and links within groups of one hash

def _sets_of(wanted):
    """Sets of the rows (text, row_key) whose key is wanted (None: of all)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        for batch in batches:
            keys = batch.column(1).to_numpy()
            chosen = np.ones(len(keys), bool) if keep is None else keep[np.minimum(np.searchsorted(keep, keys), len(keep) - 1)] == keys
            for first, last, h, rows in shingle_sets(batch.column(0)):
                start, n, f = _fingerprints(h, rows, first, last)
                ok = (n > 0) & chosen[first:last]
                _, once = np.unique(np.where(ok, f, 0), return_index=True)
                at = [i for i in once.tolist() if ok[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f[at].view(np.int64)), pa.array(n[at].astype(np.int32)),
                     pa.array([h[start[i]:start[i + 1]].tobytes() for i in at], pa.binary())], ["f", "n", "tokens"])
    return run


class Sets:
    """Shingle sets by class, with their counts by hash range for the suffix filter."""

    def __init__(self) -> None:
        self.tokens: dict[int, np.ndarray] = {}
        self.ranges: dict[int, np.ndarray] = {}

    def add(self, f: int, data: bytes) -> None:
        own = np.frombuffer(data, np.uint64)
        self.tokens[f] = own
        self.ranges[f] = np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=_RANGES)

    def link(self, a: int, b: int) -> bool:
        x, y = self.tokens[a], self.tokens[b]
        n1, n2 = len(x), len(y)
        if 4 * min(n1, n2) < 3 * max(n1, n2) or 7 * int(np.abs(self.ranges[a] - self.ranges[b]).sum()) > n1 + n2:
            return False  # too unlike in size, or apart in too many shingles counted range by range
        at = np.searchsorted(y, x)
        at[at == n2] = n2 - 1
        return linked(n1, n2, int((y[at] == x).sum()))


def _group_links(members: list[tuple[int, bytes]]) -> dict[int, list[int]]:
    """Links of each member to earlier leaders, one for each set of leaders that are joined so far."""
    sets, up = Sets(), {}

    def root(a: int) -> int:
        while up[a] != a:
            a = up[a]
        return a

    links: dict[int, list[int]] = {}
    for f, data in members:
        if f in links:
            continue
        sets.add(f, data)
        met: dict[int, int] = {}
        for leader in up:
            if (r := root(leader)) not in met and sets.link(f, leader):
                met[r] = leader
        links[f] = list(met.values())
        if met:
            top = min(met)
            for r in met:
                up[r] = top
        else:
            up[f] = f
    return links


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, f, n, tokens) sorted by place and f: one row per class with its links within the place."""
    held: list[tuple[int, bytes]] = []
    place = None

    def close() -> pa.RecordBatch:
        links, data = _group_links(held), dict(held)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(links), pa.int64()), pa.array([len(data[f]) // 8 for f in links], pa.int32()),
             pa.array([data[f] for f in links], pa.binary()), pa.array(list(links.values()), pa.list_(pa.int64()))],
            ["f", "n", "tokens", "links"])

    for batch in batches:
        for p, f, data in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
            if p != place and held:
                yield close()
                held = []
            place = p
            if not held or held[-1][0] != f:  # repeated rows come one after another
                held.append((f, data))
    if held:
        yield close()


def _placed(spark: SparkSession, sets: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """``sets`` with links among those that share the hash ``by`` of ``groups(f, low, high)``; large groups in parts of about GROUP."""
    sizes = groups.groupBy(by).agg(F.count(F.lit(1)).alias("members"))
    where = groups.join(sizes, by).select("f", F.xxhash64(by, F.pmod(F.xxhash64("f"), F.ceil(F.col("members") / GROUP))).alias("place"))
    rows = sets.join(where, "f").select("place", "f", "n", "tokens")
    return rows.repartition("place").sortWithinPartitions("place", "f").mapInArrow(_grouped, f"{_SET}, links array<long>")


# step 3: rare-first prefix join between groups

def candidate_pairs(spark: SparkSession, sets: DataFrame, group: DataFrame) -> DataFrame:
    """(a, b): pairs of classes of different groups that pass the prefix, length and positional filters."""
    own = sets.join(group, "f", "left").select("f", "n", F.coalesce("root", "f").alias("g"), "tokens")
    members = materialise(spark, own.select("f", "n", "g"), "shingle-members")
    tokens = own.select("f", "g", "tokens").mapInArrow(_explode_tokens, "f long, g long, token long")
    tokens = materialise(spark, tokens, "shingle-postings")
    rarity = tokens.groupBy("token").agg(F.min("g").alias("g1"), F.max("g").alias("g2"), F.count(F.lit(1)).alias("df")).filter("g1 <> g2")
    # only ids and tokens are shuffled; a set's size and group come back once per set
    met = tokens.select("f", "token").join(rarity.select("token", "df"), "token")
    ordered = met.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared")).join(members, "f")
    n_own = F.col("n") - F.size("shared")
    reach = _prefix(F.col("n")) - n_own
    prefix = (ordered.filter(reach > 0).select("f", "n", "g", n_own.alias("n_own"), F.posexplode(
        F.slice("shared", F.lit(1), reach.cast("int"))).alias("nth", "s"))
        .select("f", "n", "g", F.col("s.token").alias("token"), (F.col("n_own") + F.col("nth")).alias("pos")))
    prefix = materialise(spark, prefix, "shingle-prefixes")
    # of each token the group with most rows; the rows of all others look for partners, so none is sought within a group
    counts = prefix.groupBy("token", "g").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("token").agg(F.max_by("g", F.struct("c", "g")).alias("main"), F.count(F.lit(1)).alias("n_groups")).filter("n_groups > 1")
    left = prefix.join(main, "token").filter("g <> main").select("token", "main", *[F.col(c).alias(f"l_{c}") for c in ("f", "n", "g", "pos")])
    right = prefix.select("token", *[F.col(c).alias(f"r_{c}") for c in ("f", "n", "g", "pos")])
    close = (F.expr("l_g <> r_g AND (r_g = main OR l_f < r_f)")
             & F.expr("4 * least(l_n, r_n) >= 3 * greatest(l_n, r_n)")
             & F.expr("7 * least(l_n - l_pos, r_n - r_pos) >= 3 * (l_n + r_n)"))
    return left.join(right, "token").filter(close).select(
        F.least("l_f", "r_f").alias("a"), F.greatest("l_f", "r_f").alias("b")).distinct()


def _explode_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            f, g, data = (batch.column(c).slice(i, 256).to_pylist() for c in range(3))
            lengths = [len(d) // 8 for d in data]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(f, np.int64), lengths)), pa.array(np.repeat(np.array(g, np.int64), lengths)),
                 pa.array(np.frombuffer(b"".join(data), np.int64))], ["f", "g", "token"])


def _check_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, a, b, tokens) sorted by part, sets first: the pairs that link."""
    part, sets = None, Sets()
    for batch in batches:
        u, v = [], []
        for p, a, b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                part, sets = p, Sets()
            if data is not None:
                sets.add(a, data)
            elif sets.link(a, b):
                u.append(a)
                v.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def verified(pairs: DataFrame, sets: DataFrame, n_pairs: int) -> DataFrame:
    """(u, v): the pairs that link. A set travels once to each part that needs it; a class with many pairs is in many parts."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).alias("pieces")).filter("pieces > 1")
    piece = F.pmod(F.xxhash64("b"), F.coalesce("pieces", F.lit(1)))
    placed = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("a", piece), F.lit(max(1, -(-n_pairs // PART)))).alias("part"))
    need = placed.select("part", F.col("a").alias("f")).union(placed.select("part", F.col("b").alias("f"))).distinct()
    rows = need.join(sets, "f").select("part", F.col("f").alias("a"), F.lit(None).cast("long").alias("b"), "tokens").union(
        placed.select("part", "a", "b", F.lit(None).cast("binary").alias("tokens")))
    return rows.repartition("part").sortWithinPartitions("part", F.col("tokens").isNull()).select("part", "a", "b", "tokens").mapInArrow(
        _check_pairs, "u long, v long")


def jaccard_classes(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): the described rows of ``docs(doc_id, text)``, and (f, root) of every class that links with another."""
    own = docs.select("doc_id", "text")
    rows = materialise(spark, describe(own), "shingle-rows")
    classes = rows.filter("f IS NOT NULL").groupBy("f").agg(
        *[F.first(c).alias(c) for c in ("n", "n_region", "low", "high")], F.min("row_key").alias("row_key"))
    open_classes = materialise(spark, uncertified(spark, own, rows, classes).select("f", "low", "high", "row_key"), "shingle-open")
    n_open = open_classes.count()
    if not n_open:
        return rows, spark.createDataFrame([], "f long, root long")
    wanted = None
    texts = own.withColumn("row_key", _row_key())  # one row of each class, by its key: an id may be null, a text copied often
    if n_open <= MOST_SHIPPED:
        wanted = spark.sparkContext.broadcast(np.sort(open_classes.select("row_key").toArrow()["row_key"].to_numpy()))
    else:
        texts = texts.join(open_classes.select("row_key"), "row_key", "left_semi")
    found = texts.select("text", "row_key").mapInArrow(_sets_of(wanted), _SET)
    sets = materialise(spark, _placed(spark, found, open_classes, "low"), "shingle-sets")

    def edges(grouped: DataFrame) -> DataFrame:
        return grouped.select(F.col("f").alias("u"), F.explode("links").alias("v"))

    plain = sets.select("f", "n", "tokens")
    near = edges(sets).union(edges(_placed(spark, plain, open_classes, "high")))
    near = materialise(spark, near, "shingle-near")
    group = materialise(spark, connected(spark, near, "shingle-groups").select(F.col("node").alias("f"), "root"), "shingle-groups")
    pairs = materialise(spark, candidate_pairs(spark, plain, group), "shingle-pairs")
    n_pairs = pairs.count()
    if not n_pairs:
        return rows, group
    links = near.union(materialise(spark, verified(pairs, plain, n_pairs), "shingle-links"))
    return rows, connected(spark, links, "shingle-classes").select(F.col("node").alias("f"), "root")


def near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that links reach, itself included;
    rows without a doc_id take part and have the component of their links
    (null if there is no other). Null texts and texts without words have no
    set and link with nothing. Repeated rows are copies of each other. An
    empty table gives an empty result.
    """
    rows, roots = jaccard_classes(spark, docs)
    least = rows.filter("f IS NOT NULL").groupBy("f").agg(F.min("doc_id").alias("least"))
    classes = least.join(roots, "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    of_root = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("f", "root").join(of_root, "root").select("f", "component_id")
    full = rows.filter("f IS NOT NULL").join(named, "f").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.filter("f IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the component's; of rows that repeat such an id with other texts, all stay."""
    kept = near_copies(spark, docs).filter("component_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = materialise(spark, kept, "shingle-kept")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*cols)
