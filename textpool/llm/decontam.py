"""Benchmark decontamination by templates.

Numbers, units and names become typed placeholders, so a question asked again
with other values keeps its template. Hashes of template windows of the
documents are joined with those of the benchmark; the values that a match puts
in the placeholders must then agree: where the benchmark repeats a value, the
document must repeat its own. A window with too few plain words for a template
matches by its values themselves. A capitalised word that begins a sentence is
read both as a word and as a name.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpool.llm.common import free_name, materialise, slabs

WINDOW = 10
#: Of a template, so many tokens must be plain words, in proportion; other windows are exact: their values are hashed.
MIN_LITERAL = 0.5
#: Share of an item's windows that must match, in the same order and with values that agree.
MIN_SHARE = 0.1
#: Benchmark window hashes up to this number travel to the tasks and drop other windows before the join (8 bytes each).
#: Beyond it, all windows of the documents are joined; the results are the same.
MOST_SHIPPED = 4_000_000

#: Units of measure that become a placeholder after a number.
UNITS = frozenset("""
    mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms t ton tons oz lb lbs
    pound pounds ml cl l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day
    days week weeks month months year years hz khz mhz ghz w kw mw j kj cal kcal v mv ma k c f pa kpa bar mph kmh kph dollar
    dollars cent cents euro euros percent
    """.split())
#: Numbers as words.
NUMBERS = frozenset("""
    zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion
    """.split())
_NUMBER = re.compile(r"[-+$€£]?[0-9][0-9.,:/]*[%$€£]?$")
_NUMBER_UNIT = re.compile(r"([-+$€£]?[0-9][0-9.,]*)([a-z]+)$")
_STRIP = "\"'`“”‘’«»()[]{}<>.,;:!?*#&%$_~|…-"
#: Words remembered by a task.
_FORGET = 500_000
SLAB = 2_000_000

WORD, NUM, UNIT, NAME, NONE = 0, 1, 2, 3, 4
_CAPITAL, _ENDS = 8, 16
_SEED = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_word_hash = xxhash.xxh3_64_intdigest

#: Stands for a line break among the words.
_BREAK = "\ue000\ue001"


class Words(dict):
    """Numbers words as they come; keeps the hash of each bare word, and its kind by itself with flags for a capital and a sentence's end."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.traits = array("Q", [0]), array("B", [NONE | _ENDS])
        self[_BREAK] = 0

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.traits)
        if word.isalpha() and word.islower():  # most words
            self.hashes.append(_word_hash(word))
            self.traits.append(NUM if word in NUMBERS else WORD)
            return number
        bare = word.strip(_STRIP)
        low = bare.lower()
        kind = NUM if low in NUMBERS or _NUMBER.match(low) else WORD
        if kind == WORD and (m := _NUMBER_UNIT.match(low)) and m[2] in UNITS:
            kind = NUM
        capital = bool(bare) and bare[0].isupper() and not bare.isupper()
        ends = word.rstrip("\"'”’»)]").endswith((".", "!", "?", ":"))
        self.hashes.append(_word_hash(low))
        self.traits.append((kind if bare else NONE) | capital * _CAPITAL | ends * _ENDS)
        return number


def tokens(texts: list[str], words: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value hash, kind, text number and kind in the other reading of every token of the texts. Tokens of punctuation only are left out.

    A capitalised word is a name unless it begins a line or a sentence; in the
    other reading it is a name there too. A unit is a unit after a number only.
    """
    words = Words() if words is None else words
    split = [t.replace("\n", f" {_BREAK} ").split() for t in texts]
    lengths = [len(w) for w in split]
    ids = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64, sum(lengths))
    value, traits = np.array(words.hashes)[ids], np.array(words.traits)[ids]
    kind, capital, ends = traits & 7, (traits & _CAPITAL) > 0, (traits & _ENDS) > 0
    doc = np.repeat(np.arange(len(texts)), lengths)
    told = (kind != NONE) | ends
    value, kind, capital, ends, doc = value[told], kind[told], capital[told], ends[told], doc[told]
    first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    begins = first | np.r_[True, ends[:-1]] if len(doc) else first
    capital &= kind == WORD
    kind[capital & ~begins] = NAME
    bare = kind != NONE
    value, kind, doc, capital = value[bare], kind[bare], doc[bare], capital[bare]
    if len(doc):
        after = np.r_[False, (kind[:-1] == NUM) & (doc[1:] == doc[:-1])]
        kind[after & (kind == WORD) & np.isin(value, _UNIT_HASHES)] = UNIT
    return value, kind, doc, np.where(capital, NAME, kind)


_UNIT_HASHES = np.array([_word_hash(u) for u in sorted(UNITS)], np.uint64)
_PLACEHOLDER = np.array([0, *(_word_hash(f"<{k}>") for k in ("number", "unit", "name"))], np.uint64)


#: Sets the hashes of exact windows apart from those of templates.
_EXACT = np.uint64(_word_hash("<exact>"))


def windows(value: np.ndarray, kind: np.ndarray, doc: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, exact) of all windows of ``size`` tokens, none across texts; exact are those with too few plain words for a template."""
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    template = np.where(kind == WORD, value, _PLACEHOLDER[kind])
    factor = _mix(np.arange(1, size + 1, dtype=np.uint64) + np.uint64(size * _SEED % (1 << 64))) | np.uint64(1)
    h = template[:n] * factor[0]
    for j in range(1, size):
        h += template[j:j + n] * factor[j]
    plain = np.r_[0, np.cumsum(kind == WORD)]
    start = np.flatnonzero(doc[size - 1:] == doc[:n])
    exact = (plain[size:] - plain[:-size])[start] < max(1, MIN_LITERAL * size)
    at = start[exact]
    if len(at):
        h[at] = _EXACT
        for j in range(size):
            h[at] += value[at + j] * factor[j]
    return start, _mix(h[start]), exact


_WINDOW_FIELDS = "pos int, hash long, vals array<long>, exact boolean, readings int"


def _rows(words: Words, ids: list, texts: list, size: int, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """One row per window and hash: id, pos, hash, the values in its placeholders in order (none if exact), exact, readings, tokens of the text.

    ``readings`` is 1 for the first reading of ``tokens``, 2 for the other, 3 for both.
    """
    value, kind, doc, other = tokens(texts, words)
    start, h, exact = windows(value, kind, doc, size)
    start2, h2, exact2 = windows(value, other, doc, size)
    differ = h != h2
    first = np.searchsorted(doc, np.arange(len(texts) + 1))

    def batch(kind, start, h, exact, readings) -> pa.RecordBatch:
        if wanted is not None and len(h):
            at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
            ok = (wanted[at] == h) if len(wanted) else np.zeros(len(h), bool)
            start, h, exact, readings = start[ok], h[ok], exact[ok], readings[ok]
        slots = np.flatnonzero(kind != WORD)
        low = np.searchsorted(slots, start)
        high = np.where(exact, low, np.searchsorted(slots, start + size))
        flat = np.arange((high - low).sum()) + np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low) if len(start) else np.zeros(0, np.int64)
        vals = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(high - low)].astype(np.int32)), pa.array(value[slots[flat]].view(np.int64)))
        of = doc[start]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(ids, np.int64)[of]), pa.array((start - first[of]).astype(np.int32)), pa.array(h.view(np.int64)), vals, pa.array(exact),
             pa.array(readings.astype(np.int32)), pa.array((first[of + 1] - first[of]).astype(np.int32))],
            ["id", "pos", "hash", "vals", "exact", "readings", "n_tokens"])

    yield batch(kind, start, h, exact, np.where(differ, 1, 3))
    if differ.any():
        yield batch(other, start2[differ], h2[differ], exact2[differ], np.full(int(differ.sum()), 2))


def _windows_of(rows: DataFrame, sizes: list[int], wanted, whole: bool = False) -> DataFrame:
    """Windows of all ``sizes``; with ``whole``, of a text shorter than the first size the one window that it is, so every text with a token has one."""
    def run(batches):
        keep = None if wanted is None else wanted.value
        words = Words()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slabs(np.array([len(t) for t in texts]), SLAB):
                if len(words) > _FORGET:
                    words = Words()
                if not whole:
                    for size in sizes:
                        yield from _rows(words, ids[a:b], texts[a:b], size, keep)
                    continue
                for i, t in zip(ids[a:b], texts[a:b], strict=True):
                    n = len(tokens([t], words)[0])
                    if n:
                        own = list(_rows(words, [i], [t], min(n, sizes[0]), keep))
                        if not own[0].num_rows:
                            raise ValueError(f"benchmark item {i} has no window")
                        yield from own

    return rows.mapInArrow(run, f"id long, {_WINDOW_FIELDS}, n_tokens int")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                 min_share: float = MIN_SHARE) -> DataFrame:
    """(id, item_key, item_id, n_windows, share, first_token): the documents, by row key, that hold an item's template.

    ``id`` is ``doc_row_key`` of the document's row, ``item_key`` that of the
    benchmark's; items without an ``item_id`` are searched for like others,
    repeated items count once. A window of a document matches one of an item
    with the same template; matches at the same offset form an alignment,
    whose placeholder values must agree; it is judged for each reading of the
    document with each of the item. An alignment counts when it covers
    ``min_share`` of the item's windows, or of its templates alone. Exact
    windows hold no placeholder values; those of an alignment whose values
    disagree still count by themselves. Items shorter than a window match
    documents by windows of their own length, so an item of one word is found
    wherever that word stands. Null and empty texts match nothing, repeated
    rows are judged alike, empty tables give an empty result.

    An alignment that counts holds one of any ``total - needed + 1`` windows of
    its item, so documents meet items by the windows that fewest items share,
    and only such pairs by all windows: a passage that many items share does
    not multiply documents by items.
    """
    items = benchmark.select(doc_row_key("item_id").alias("id"), F.col("item_id").cast("long").alias("item_id"),
                             F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["id"])
    own = materialise(spark, _windows_of(items.select("id", "text"), [size], None, True), "benchmark-windows")
    lengths = [r[0] for r in own.filter(F.col("n_tokens") < size).select("n_tokens").distinct().collect()]  # fewer than ``size``
    rows = docs.select(doc_row_key().alias("id"), "text").filter(F.col("text").isNotNull())
    hashes = own.select("hash").distinct()
    n = hashes.count()
    wanted = None
    if n <= MOST_SHIPPED:
        wanted = spark.sparkContext.broadcast(np.sort(hashes.toArrow()["hash"].to_numpy().view(np.uint64)))
    seen = _windows_of(rows, [size, *sorted(lengths, reverse=True)], wanted).select("id", "pos", "hash", "vals", "readings")
    seen = materialise(spark, seen if wanted is not None else seen.join(hashes, "hash", "left_semi"), "document-windows")
    # of each reading of an item: its windows, and those that are templates; a window is in a reading once
    read = own.select(F.col("id").alias("item_key"), "pos", "hash", "exact", F.explode(_readings("readings")).alias("item_reading"))
    totals = read.groupBy("item_key", "item_reading").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(~F.col("exact"), 1)).alias("templates"))
    item = own.select(F.col("id").alias("item_key"), F.col("pos").alias("item_pos"), "hash", F.col("vals").alias("item_vals"), "exact",
                      F.col("readings").alias("item_readings"))
    pairs = materialise(spark, seen.select("id", "hash").join(_rare_windows(read, totals, min_share), "hash")
                        .select("id", "item_key").distinct(), "document-items")
    met = pairs.join(item, "item_key").join(seen, ["id", "hash"]).withColumn("offset", F.col("pos") - F.col("item_pos"))
    # pairs (item value, document value) of each placeholder; one item value must always meet the same document value
    met = met.withColumn("pairs", F.arrays_zip(F.col("item_vals").alias("a"), F.col("vals").alias("b")).cast("array<struct<a:bigint,b:bigint>>"))
    met = met.withColumn("reading", F.explode(_readings("readings"))).withColumn("item_reading", F.explode(_readings("item_readings")))
    aligned = met.groupBy("id", "item_key", "offset", "reading", "item_reading").agg(
        F.size(F.collect_set("item_pos")).alias("n_all"), F.size(F.collect_set(F.when(F.col("exact"), F.col("item_pos")))).alias("n_exact"),
        F.min("pos").alias("first_all"), F.min(F.when(F.col("exact"), F.col("pos"))).alias("first_exact"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    agrees = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs")
    of_all = F.greatest(F.col("n_all") / F.col("total"), (F.col("n_all") - F.col("n_exact")) / F.greatest("templates", F.lit(1)))
    judged = aligned.withColumn("agrees", agrees).join(totals, ["item_key", "item_reading"]).select(
        "id", "item_key", F.when(F.col("agrees"), F.col("n_all")).otherwise(F.col("n_exact")).cast("long").alias("n_windows"),
        F.when(F.col("agrees"), of_all).otherwise(F.col("n_exact") / F.col("total")).alias("share"),
        F.when(F.col("agrees"), F.col("first_all")).otherwise(F.col("first_exact")).alias("first_token"))
    best = (judged.filter((F.col("n_windows") > 0) & (F.col("share") >= min_share)).groupBy("id", "item_key")
            .agg(F.max("n_windows").alias("n_windows"), F.max("share").alias("share"), F.min("first_token").alias("first_token")))
    return best.join(items.select(F.col("id").alias("item_key"), "item_id"), "item_key").select(
        "id", "item_key", "item_id", "n_windows", "share", "first_token")


def _rare_windows(read: DataFrame, totals: DataFrame, min_share: float) -> DataFrame:
    """(hash, item_key): of each reading, the windows in fewest items, so many that every alignment that counts holds one.

    That is asked of all windows and of the templates alone.
    """
    held = read.groupBy("hash").agg(F.countDistinct("item_key").alias("n_items"))
    ordered = read.join(held, "hash").join(totals, ["item_key", "item_reading"])

    def enough(total: str):
        return F.col(total) - F.ceil(F.col(total) * F.lit(min_share) - F.lit(1e-9)) + 1

    by_reading = Window.partitionBy("item_key", "item_reading").orderBy("n_items", "hash", "pos")
    by_kind = Window.partitionBy("item_key", "item_reading", "exact").orderBy("n_items", "hash", "pos")
    ordered = ordered.withColumn("place", F.row_number().over(by_reading)).withColumn("kind_place", F.row_number().over(by_kind))
    first = (F.col("place") <= enough("total")) | (~F.col("exact") & (F.col("kind_place") <= enough("templates")))
    return ordered.filter(first).select("hash", "item_key").distinct()


def _readings(bits: str):
    """The readings, 1 and 2, that are set in ``bits``."""
    return F.when(F.col(bits) == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col(bits)))


def doc_row_key(id_column: str = "doc_id"):
    """Key of a document's or item's row: equal for repeated rows only."""
    return F.xxhash64(F.col(id_column), F.coalesce(F.col("text"), F.lit("")))


def contamination_digest(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, share, first_token of every contaminated document and item: what the registered query returns.

    ``item_id`` is null for an item without one; equal rows are returned once.
    """
    own = docs.select("doc_id", "text")
    hits = materialise(spark, contaminated(spark, own, benchmark), "contaminated")
    ids = own.select("doc_id", doc_row_key().alias("id"))
    return ids.join(hits, "id").select("doc_id", "item_id", "n_windows", "share", "first_token").distinct()


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    key = free_name(docs.columns, "row_key")
    hits = materialise(spark, contaminated(spark, docs.select("doc_id", "text"), benchmark).select(F.col("id").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, doc_row_key()).join(hits, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
