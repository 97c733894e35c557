"""Spelling variants by a dictionary of trie-node pairs.

The nodes of the trie of all words and of the trie of all reversed words are
numbered. A word with position i skipped is the pair (node of its first i
letters, node of the letters after i); with a gap at i it is the pair (node
of its first i letters, node of the rest). Two words differ by one replaced
letter if a skip pair of both is the same, and by one inserted letter if a
skip pair of one is a gap pair of the other, so equal integer pairs give all
neighbours and nothing else. At most one word and its one-letter variants
hold a pair, however many words there are, and words are judged against the
group's best, never pair by pair.

Words are sorted over range partitions, so a word shares its nodes with the
word before it up to their common prefix; numbers are dealt in one pass, and
one row per range partition joins the partitions' numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpool.functions.arrays import explode_values
from textpool.llm.common import lower_ascii, materialise, slabs
from textpool.session import checkpoint_root

MIN_CHARS = 5
MIN_COUNT = 3
#: A form is at least this many times as frequent as its variant.
RATIO = 2
#: One in this many occurrences loses a letter, by its checksum.
SLIP = 97
#: Pair rows that leave a task at once.
PAIR_ROWS = 1 << 20

GAP, SKIP, REPEAT = 0, 1, 2


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts, after the slips that the checksums ask for."""
    # shorter runs cannot give a word: a slip only takes letters away
    runs = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"[a-z\\u00C0-\\u00FF]{{{MIN_CHARS},}}"), F.lit(0))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    each = explode_values(docs.select(key.alias("key"), runs.alias("runs")), ["key"], F.col("runs"), "run")
    h = F.crc32(F.concat("key", "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = each.select(F.when(h % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= MIN_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class _Nodes:
    """Deals numbers to the trie nodes of words that arrive sorted: those of the last word by depth, and how many there are."""

    def __init__(self):
        self.word, self.path, self.dealt = "", [], 0

    def add(self, word: str) -> int:
        common = _shared(self.word, word)
        fresh = len(word) - common
        self.path = self.path[:common] + list(range(self.dealt, self.dealt + fresh))
        self.word, self.dealt = word, self.dealt + fresh
        return common


def _sorted_words(spark: SparkSession, words: DataFrame, key: str) -> DataFrame:
    """``words`` cut into ranges of ``key`` and sorted in them; written, so that every later pass sees the same ranges."""
    checkpoint_root(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, or few small ranges would be merged before they grow to pairs
    return words.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)


def _starts(ranged: DataFrame, key: str) -> dict[int, tuple[int, int, list[int]]]:
    """part -> (rows before it, nodes before it, numbers of the nodes that its first word shares with the word before).

    One row per range partition comes to the driver.
    """
    def summarise(batches):
        nodes, first, rows, part = _Nodes(), None, 0, None
        for batch in batches:
            for word in batch.column(0).to_pylist():
                first = word if first is None else first
                nodes.add(word)
            rows += batch.num_rows
            if batch.num_rows:
                part = batch.column(1)[0].as_py()
        if rows:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "rows": pa.array([rows], pa.int64()), "dealt": pa.array([nodes.dealt], pa.int64()),
                "first": [first], "last": [nodes.word], "path": pa.array([nodes.path], pa.list_(pa.int64()))})

    schema = "part int, rows long, dealt long, first string, last string, path array<long>"
    starts, last, path, n_rows, n_nodes = {}, "", [], 0, 1  # number 0 is the root
    for r in sorted(ranged.select(key, "_part").mapInArrow(summarise, schema).collect(), key=lambda r: r.part):
        common = _shared(last, r.first)
        starts[r.part] = (n_rows, n_nodes, path[:common])
        path = [path[j] if j < common else n_nodes + j - common for j in r.path]
        last, n_rows, n_nodes = r.last, n_rows + r.rows, n_nodes + r.dealt - common
    return starts


def _numbered(batch, key, nodes: _Nodes, start):
    """Per word of a sorted batch, the global numbers of its nodes from the root down: flat numbers and word lengths."""
    _, base, shared = start
    flat, sizes = [], []
    for word in batch.column(key).to_pylist():
        nodes.add(word)
        flat.append(0)
        flat.extend(nodes.path)
        sizes.append(len(word))
    local, sizes = np.array(flat, np.int64), np.array(sizes, np.int64)
    heads = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(sizes) else sizes
    known = np.array([*shared, 0], np.int64)
    out = np.where(local < len(shared), known[np.minimum(local, len(shared))], base + local - len(shared))
    out[heads] = 0
    return out, sizes, heads


def numbered_words(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """(id, word, n, nodes): words numbered in code-point order, with the numbers of their trie nodes from the root down."""
    ranged = _sorted_words(spark, counts, "word")
    starts = _starts(ranged, "word")

    def number(batches):
        nodes, row = _Nodes(), 0
        for batch in batches:
            if batch.num_rows:
                start = starts[batch.column("_part")[0].as_py()]
                flat, sizes, _ = _numbered(batch, "word", nodes, start)
                ids = np.arange(batch.num_rows) + start[0] + row
                row += batch.num_rows
                bounds = np.concatenate(([0], np.cumsum(sizes + 1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("word"), batch.column("n"),
                                                  pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], ["id", "word", "n", "nodes"])

    return materialise(spark, ranged.mapInArrow(number, "id long, word string, n long, nodes array<long>"), "spelling-words")


def node_pairs(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(prefix, suffix, id, kind, n): every word with each position skipped, and with a gap at each place.

    ``kind``: GAP; SKIP; REPEAT for a skipped letter that equals the one
    before it, which gives the same rest as skipping that one.
    """
    ranged = _sorted_words(spark, words.select("id", "n", "nodes", F.reverse("word").alias("drow")), "drow")
    starts = _starts(ranged, "drow")

    def pairs(batches):
        trie = _Nodes()
        for batch in batches:
            if not batch.num_rows:
                continue
            suffix, sizes, heads = _numbered(batch, "drow", trie, starts[batch.column("_part")[0].as_py()])
            prefix = batch.column("nodes").flatten().to_numpy()
            ids, counts = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            words = [w[::-1] for w in batch.column("drow").to_pylist()]
            for a, b in slabs(2 * sizes + 1, PAIR_ROWS):
                n, lo, hi = sizes[a:b], heads[a], heads[b - 1] + sizes[b - 1] + 1
                word = np.repeat(np.arange(a, b), n + 1)
                depth = np.arange(lo, hi) - heads[word]
                front = prefix[lo:hi]
                back = suffix[heads[word] + sizes[word] - depth]  # the suffix that begins at depth
                inner = depth < sizes[word]
                letters = np.frombuffer("".join(words[a:b]).encode("utf-32-le"), np.uint32)
                repeat = np.zeros(len(letters), bool)
                repeat[1:] = letters[1:] == letters[:-1]
                repeat[np.concatenate(([0], np.cumsum(n)[:-1]))] = False
                skipped = np.flatnonzero(inner)
                rows = np.concatenate((word, word[skipped]))
                kind = np.concatenate((np.full(len(word), GAP, np.int8), np.where(repeat, REPEAT, SKIP).astype(np.int8)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((front, front[skipped]))), pa.array(np.concatenate((back, back[skipped + 1]))),
                     pa.array(ids[rows]), pa.array(kind), pa.array(counts[rows])], ["prefix", "suffix", "id", "kind", "n"])

    return ranged.mapInArrow(pairs, "prefix long, suffix long, id long, kind byte, n long")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best struct<n, neg_id>): how many words are near a word, and the most frequent (smallest on ties).

    A pair is held by one word with a gap there and by words that have one
    letter in its place: at most the size of the alphabet. Each of them is
    near all the others (the gap's word only to letters that are no repeat),
    and its best is the group's first or second.
    """
    rank = F.struct("n", (-F.col("id")).alias("neg_id"), "kind")
    groups = pairs.groupBy("prefix", "suffix").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") != GAP, rank)), asc=False).alias("held"),
        F.max(F.when(F.col("kind") == GAP, F.struct("n", (-F.col("id")).alias("neg_id")))).alias("gap")).filter(
        (F.size("held") > 1) | ((F.size("held") == 1) & F.col("gap").isNotNull()))
    plain = lambda x: F.struct(x["n"].alias("n"), x["neg_id"].alias("neg_id"))
    single = F.filter("held", lambda x: x["kind"] == SKIP)
    has_gap = F.col("gap").isNotNull()
    members = F.transform("held", lambda x, i: F.struct(
        (-x["neg_id"]).alias("id"), (F.size("held") - 1 + F.when(has_gap & (x["kind"] == SKIP), 1).otherwise(0)).alias("near"),
        F.greatest(plain(F.get("held", F.when(i == 0, 1).otherwise(0))),
                   F.when(x["kind"] == SKIP, F.col("gap"))).alias("best")))
    of_gap = F.filter(F.array(F.struct((-F.col("gap.neg_id")).alias("id"), F.size(single).alias("near"),
                                       plain(F.get(single, F.lit(0))).alias("best"))), lambda x: has_gap & (x["near"] > 0))
    found = groups.select(F.explode(F.concat(members, of_gap)).alias("m")).select("m.*").filter("near > 0")
    return found.groupBy("id").agg(F.sum("near").cast("long").alias("n_near"), F.max("best").alias("best"))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(id, root) of ``forms(id, form)``: the last of the chain of forms, by doubling the length of every jump.

    Counts double along a chain, so a chain is short and has no cycle.
    """
    ptr = materialise(spark, forms.select("id", F.col("form").alias("root"), F.lit(False).alias("last")), "spelling-roots")
    while ptr.filter("NOT last").limit(1).count():
        ahead = ptr.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("last").alias("next_last"))
        moved = ptr.filter("NOT last").join(ahead, "root", "left")
        moved = moved.select("id", F.coalesce("next", "root").alias("root"), F.coalesce("next_last", F.lit(True)).alias("last"))
        ptr = materialise(spark, moved.union(ptr.filter("last").select("id", "root", "last")), "spelling-roots")
    return ptr.select("id", "root")


def spelling_variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of ``docs``.

    Words are the runs of letters A-Z, a-z and U+00C0 to U+00FF, in lower
    case (A-Z only), after the slips; they have ``MIN_CHARS`` code points or
    more and occur ``MIN_COUNT`` times or more. A null text has none, a null
    doc_id is the empty string in the checksum; repeated rows count each
    time. Ties between near words go to the smallest in code-point order. A
    word without a form is its own root. Words of any length are taken whole;
    their rows grow with their length. Other columns are ignored. No words
    give no rows.
    """
    words = numbered_words(spark, word_counts(docs.select("doc_id", "text")))
    near = materialise(spark, neighbours(node_pairs(spark, words)), "spelling-near")
    named = words.select("id", "word", "n")
    judged = named.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.n") >= F.col("n") * RATIO, -F.col("best.neg_id")).alias("form"),
        F.when(F.col("best.n") >= F.col("n") * RATIO, F.col("best.n")).alias("form_n"))
    judged = materialise(spark, judged, "spelling-judged")
    chains = roots(spark, judged.filter("form IS NOT NULL").select("id", "form"))
    name = lambda c, out: named.select(F.col("id").alias(c), F.col("word").alias(out))
    formed = judged.filter("form IS NOT NULL").join(chains, "id").join(name("form", "form_word"), "form") \
        .join(name("root", "root_word"), "root").select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"),
                                                        "n", "n_near", "form_n")
    return formed.union(judged.filter("form IS NULL").select("word", F.lit(None).cast("string"), "word", "n", "n_near", "form_n"))


#: The checksum is folded over bytes with the table of the reflected polynomial EDB88320.
SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(1, octet_length(encode(key)) + 1),
           lambda i: CAST('0x' || substr(hex(encode(key)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)),
         lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) AS h
  FROM counted, crc_table),
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
         ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
skips AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS front, substr(word, i + 1) AS back
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.front = b.front AND a.back = b.back AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM skips s JOIN words w ON w.word = s.front || s.back
  UNION SELECT w.word, s.word, s.n FROM skips s JOIN words w ON w.word = s.front || s.back),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top, min(other) FILTER (other_n = top_n) AS first
  FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS top_n FROM near) GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN b.first END AS form,
         CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
