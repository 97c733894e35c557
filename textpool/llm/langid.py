"""Language identification with interpolated Kneser-Ney character models.

One model per learned language, orders 1 to 4 over lower-cased letters with
one boundary symbol for everything else. Four symbols of 16 bits make one
64-bit key, so an n-gram table is a sorted array of keys; each key lists the
languages that hold it with their log probabilities, and no others, so the
tables grow with what the languages hold, not with keys times languages.
The language with the lowest cross-entropy per
symbol wins; texts no language explains well are rejected, by bounds that
are calibrated on labelled texts outside the counted sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from textpool.llm.common import materialise, slabs

ORDER = 4
#: Bounds of the labelled sample that is counted, per language: distinct texts and code points.
FIT_ROWS, FIT_CHARS = 2_000, 6_000_000
#: So many distinct texts per language, if it has them, are in the sample whatever their length.
LEAST_ROWS = 200
#: Of the sample, one text in so many calibrates and is not counted.
CALIBRATE_ONE_IN = 5
#: A text is rejected when its excess over the mean cross-entropy, times the root of its length
#: (``LONG`` symbols at most), is above this multiple of the largest seen in calibration.
REJECT_MARGIN, LONG = 1.5, 400
#: Most (language, n-gram) counts that the driver takes and the tasks get (20 bytes each); beyond, ``fit`` refuses.
MOST_COUNTS = 200_000_000
UNDETERMINED = "und"
SLAB = 4_000_000


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all ORDER-grams of the texts and the text number of each.

    A symbol is a letter, lower-cased; any run of other characters, and the
    end of a text, is one boundary (0). Before a text lie boundaries.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.zeros(int(points.max()) + 1, np.uint16)
    for c in np.flatnonzero(np.bincount(points)):
        if chr(c).isalpha():
            code[c] = c % 65521 + 1
    sym = code[points]
    keep = sym != 0
    keep[1:] |= sym[:-1] != 0
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])[keep]
    sym = sym[keep].astype(np.uint64)
    start = np.searchsorted(doc, np.arange(len(texts)))
    place = np.arange(len(sym)) - start[doc]
    keys = sym.copy()
    for j in range(1, ORDER):
        moved = np.zeros_like(sym)
        moved[j:] = sym[:-j]
        moved[place < j] = 0
        keys |= moved << np.uint64(16 * j)
    return keys, doc


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def _table(per: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, where each key's entries begin, language of each entry, its value) of the (keys, values) of each language."""
    keys = np.concatenate([k for k, _ in per])
    order = np.argsort(keys, kind="stable")
    lang = np.repeat(np.arange(len(per), dtype=np.int32), [len(k) for k, _ in per])[order]
    value = np.concatenate([v for _, v in per]).astype(np.float32)[order]
    keys, first = np.unique(keys[order], return_index=True)
    return keys, np.r_[first, len(lang)], lang, value


def _entries(table: tuple, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``wanted``, language, value) of the entries of each wanted key."""
    keys, first, lang, value = table
    at, hit = _find(keys, wanted)
    rows, at = np.flatnonzero(hit), at[hit]
    n = first[at + 1] - first[at]
    entry = np.repeat(first[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
    return np.repeat(rows, n), lang[entry], value[entry]


@dataclass
class CharModels:
    """Tables by order (see ``_table``): n-grams with log p, contexts with log back-off weight."""

    langs: list[str]
    grams: dict[int, tuple] = field(default_factory=dict)
    contexts: dict[int, tuple] = field(default_factory=dict)
    unseen: np.ndarray | None = None
    mean: np.ndarray | None = None
    bound: np.ndarray | None = None
    sharpness: float = 20.0

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probability of each key's last symbol given the others, one column per language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        todo = np.ones(out.shape, bool)
        for n in range(ORDER, 0, -1):
            rows, lang, value = _entries(self.grams[n], keys)
            own = todo[rows, lang]
            out[rows[own], lang[own]] += value[own]
            todo[rows, lang] = False
            if n == 1:
                out += np.where(todo, self.unseen, np.float32(0))
                break
            rows, lang, value = _entries(self.contexts[n], keys >> np.uint64(16))
            own = todo[rows, lang]
            out[rows[own], lang[own]] += value[own]
            keys = keys & np.uint64((1 << 16 * (n - 1)) - 1)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text under each language, and its number of symbols (0: no letter)."""
        total = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts), np.int64)
        for a, b in slabs(np.array([len(t) for t in texts]), max(50_000, SLAB // max(1, len(self.langs)))):
            if not any(texts[a:b]):
                continue
            keys, doc = symbols(texts[a:b])
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            distinct, place = np.unique(keys, return_inverse=True)
            of_distinct = self.log_p(distinct)
            for i in range(len(self.langs)):
                total[a + doc[starts], i] = -np.add.reduceat(np.ascontiguousarray(of_distinct[:, i])[place], starts, dtype=np.float64)
            count[a:b] = np.bincount(doc, minlength=b - a)
        return total / np.maximum(count, 1)[:, None], count

    def decide(self, texts: list[str]) -> dict[str, np.ndarray]:
        entropy, count = self.entropies(texts)
        rows = np.arange(len(texts))
        best = entropy.argmin(axis=1)
        low = entropy[rows, best]
        share = 1 / np.exp(-self.sharpness * (entropy - low[:, None])).sum(axis=1)
        excess = (low - self.mean[best]) * np.sqrt(np.minimum(count, LONG))
        return {"best": best, "score": np.where(count > 0, share, 0.0), "entropy": low, "count": count,
                "rejected": (count == 0) | (excess > self.bound[best])}


def estimate(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> CharModels:
    """Interpolated Kneser-Ney from the ORDER-gram counts (sorted keys, counts) of each language.

    Lower orders count the distinct symbols that come before an n-gram. Each
    order has one discount, n1 / (n1 + 2 n2) of its counts of counts.
    """
    model = CharModels(langs)
    letters = len(np.unique(np.concatenate([counts[lang][0] & np.uint64(0xFFFF) for lang in langs])))
    grams, contexts = ({n: [] for n in range(1, ORDER + 1)} for _ in range(2))
    model.unseen = np.zeros(len(langs), np.float32)
    for i, lang in enumerate(langs):
        orders = {ORDER: (counts[lang][0], counts[lang][1].astype(float))}
        for n in range(ORDER - 1, 0, -1):
            keys, c = np.unique(orders[n + 1][0] & np.uint64((1 << 16 * n) - 1), return_counts=True)
            orders[n] = keys, c.astype(float)
        lower = None
        for n in range(1, ORDER + 1):
            keys, c = orders[n]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context, at = np.unique(keys >> np.uint64(16), return_inverse=True) if n > 1 else (np.zeros(1, np.uint64), np.zeros(len(keys), int))
            total = np.bincount(at, weights=c)
            back = discount * np.bincount(at) / total
            below = 1.0 / (letters + 1) if n == 1 else lower[1][np.searchsorted(lower[0], keys & np.uint64((1 << 16 * (n - 1)) - 1))]
            p = np.maximum(c - discount, 0) / total[at] + back[at] * below
            grams[n].append((keys, np.log(p)))
            contexts[n].append((context, np.log(back)))
            if n == 1:
                model.unseen[i] = np.log(back[0] / (letters + 1))
            lower = keys, p
    model.grams = {n: _table(grams[n]) for n in grams}
    model.contexts = {n: _table(contexts[n]) for n in contexts if n > 1}
    return model


def held_out(doc_id="doc_id"):
    """crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(spark: SparkSession, docs: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> DataFrame:
    """(lang, text, calibrates): per language, the first ``fit_rows`` distinct labelled texts by their hash.

    A text that begins beyond ``fit_chars`` code points of those before it is
    left out, unless it is among the first ``LEAST_ROWS``. Held-out documents,
    null languages, and texts without a letter are left out. Copies of a text
    count once, in rows and in code points. The first text of a language never
    calibrates, so each language of the sample is counted.
    """
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.xxhash64("text").alias("hash"))
    place = F.pmod(F.col("hash"), F.lit(1 << 30)) * (1 << 33) + F.pmod(F.shiftright("hash", 30), F.lit(1 << 33))  # order of the texts
    distinct = rows.groupBy("lang", place.alias("place")).agg(F.max(F.length("text")).cast("long").alias("chars"))
    distinct = materialise(spark, distinct, "language-texts")  # three numbers a text
    # whole ranges of places before the bounds, by their sums; then the few texts that are left, one by one
    part = F.shiftright("place", 53)
    sums = distinct.groupBy("lang", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("lang").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
                       F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    least = min(LEAST_ROWS, fit_rows)
    sums = sums.filter((F.col("n_before") < fit_rows) & ((F.col("chars_before") < fit_chars) | (F.col("n_before") < least)))
    near = distinct.join(sums.select("l", "p"), (F.col("lang") == F.col("l")) & (part == F.col("p"))).select("lang", "place", "chars")
    before = Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    near = near.select("lang", "place", F.row_number().over(Window.partitionBy("lang").orderBy("place")).alias("nth"),
                       F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    taken = near.filter((F.col("nth") <= fit_rows) & ((F.col("chars_before") < fit_chars) | (F.col("nth") <= least)))
    bounds = taken.groupBy(F.col("lang").alias("l")).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    bounds = materialise(spark, bounds, "language-bounds")  # a row per language, of known size
    calibrates = (F.pmod(F.shiftright("hash", 30), F.lit(CALIBRATE_ONE_IN)) == 0) & (place != F.col("first"))
    return (rows.join(bounds, F.col("lang") == F.col("l")).filter(place <= F.col("last"))
            .dropDuplicates(["lang", "hash"]).select("lang", "text", calibrates.alias("calibrates")))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for a, b in slabs(np.array([len(t) for t in own]), SLAB):
                keys, counts = np.unique(symbols(own[a:b])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)],
                    ["lang", "key", "n"])


def fit(spark: SparkSession, docs: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> CharModels | None:
    """Models of all languages of ``docs(doc_id, text, lang)``; None when no row can be learned from.

    Counted on the executors; the driver gets the n-gram counts of the
    bounded sample, at most ``MOST_COUNTS`` (a ValueError beyond: take fewer
    ``fit_chars``, or mend a ``lang`` column that holds no languages).
    """
    def counts_of(rows: DataFrame) -> pa.Table:
        counted = rows.select("lang", "text").mapInArrow(_count_grams, "lang string, key long, n long")
        counted = materialise(spark, counted.groupBy("lang", "key").agg(F.sum("n").alias("n")), "language-counts")
        if counted.count() > MOST_COUNTS:
            raise ValueError(f"more than {MOST_COUNTS} (language, n-gram) counts")
        return counted.toArrow()

    sample = training_sample(spark, docs, fit_rows, fit_chars)
    table = counts_of(sample.filter("NOT calibrates"))
    if not table.num_rows:  # nothing to count in the first texts
        sample = sample.withColumn("calibrates", F.lit(True))
        table = counts_of(sample)
        if not table.num_rows:
            return None
    table = table.sort_by([("lang", "ascending")]).combine_chunks()
    of = pc.dictionary_encode(table["lang"].combine_chunks())
    number, keys, n = of.indices.to_numpy(), table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    langs, counts = of.dictionary.to_pylist(), {}
    starts = np.searchsorted(number, np.arange(len(langs) + 1))
    for i, lang in enumerate(langs):
        own = slice(starts[i], starts[i + 1])
        order = np.argsort(keys[own])
        counts[lang] = keys[own][order], n[own][order]
    model = estimate(langs, counts)
    _calibrate(spark, model, sample.filter("calibrates"))
    return model


def _calibrate(spark: SparkSession, model: CharModels, sample: DataFrame) -> None:
    shared = spark.sparkContext.broadcast(vars(model))  # plain arrays: a worker may not have this package

    def entropies(batches):
        models = CharModels(**shared.value)
        for batch in batches:
            entropy, count = models.entropies(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(entropy), pa.list_(pa.float64())), pa.array(count)],
                                             ["lang", "entropy", "n"])

    rows = sample.select("lang", "text").mapInArrow(entropies, "lang string, entropy array<double>, n long").toArrow()
    place = {lang: i for i, lang in enumerate(model.langs)}
    lang = np.array([place.get(x, -1) for x in rows["lang"].to_pylist()], int)
    entropy = np.array(rows["entropy"].to_pylist(), float).reshape(len(lang), -1)[lang >= 0] if len(lang) else np.zeros((0, len(model.langs)))
    count, lang = rows["n"].to_numpy()[lang >= 0], lang[lang >= 0]
    own = entropy[np.arange(len(lang)), lang] if len(lang) else np.zeros(0)
    everywhere = own.mean() if len(own) else 3.0
    model.mean = np.array([own[lang == i].mean() if (lang == i).any() else everywhere for i in range(len(model.langs))])
    excess = (own - model.mean[lang]) * np.sqrt(np.minimum(count, LONG)) if len(own) else own
    most = max(excess.max(), 1.0) if len(excess) else 10.0
    model.bound = np.array([REJECT_MARGIN * max(excess[lang == i].max(), 0.5 * most) if (lang == i).any() else REJECT_MARGIN * most
                            for i in range(len(model.langs))])
    if len(own):
        def loss(k: float) -> float:
            z = -k * entropy
            z -= z.max(axis=1, keepdims=True)
            return -(z[np.arange(len(lang)), lang] - np.log(np.exp(z).sum(axis=1))).mean()
        model.sharpness = min((1.0, 2.0, 5.0, 10.0, 20.0, 50.0), key=loss)


def identify(spark: SparkSession, docs: DataFrame, model: CharModels | None, text: str = "text",
             returned: list[str] | None = None) -> DataFrame:
    """``docs`` with ``langid struct<lang, score, cross_entropy, rejected>`` and all its rows in ``row``.

    ``row`` holds the columns ``returned`` (None: all). Each column travels to
    the tasks' Python once, and only these come back.

    ``lang`` is a learned language, or ``und`` for a null text or one without
    a letter (score 0, rejected). Ties go to the first language in text order.
    ``rejected`` texts are those that no language explains. Without a model
    every text is ``und`` and rejected. Repeated rows get equal results, an
    empty table an empty one.
    """
    shared = spark.sparkContext.broadcast(None if model is None else vars(model))
    at = docs.columns.index(text)
    names = docs.columns if returned is None else returned
    back = [docs.columns.index(c) for c in names]

    def run(batches):
        models = None if shared.value is None else CharModels(**shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if models is None:
                best = [UNDETERMINED] * len(texts)
                d = {"score": np.zeros(len(texts)), "entropy": np.zeros(len(texts)), "rejected": np.ones(len(texts), bool)}
            else:
                d = models.decide(texts)
                best = [models.langs[i] if n else UNDETERMINED for i, n in zip(d["best"], d["count"], strict=True)]
            found = pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(d["score"], pa.float64()),
                                                pa.array(d["entropy"], pa.float64()), pa.array(d["rejected"], pa.bool_())],
                                               ["lang", "score", "cross_entropy", "rejected"])
            row = pa.StructArray.from_arrays([batch.column(i) for i in back], names)
            yield pa.RecordBatch.from_arrays([row, found], ["row", "langid"])

    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = StructType([StructField("row", StructType([StructField(n, flat.schema[i].dataType) for i, n in zip(back, names, strict=True)])),
                         StructField("langid", StructType.fromDDL("lang string, score double, cross_entropy double, rejected boolean"))])
    return flat.mapInArrow(run, schema)


def langid_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected: what the registered query returns."""
    model = fit(spark, docs.select("doc_id", "text", "lang"))
    slim = docs.select("doc_id", held_out().alias("held_out"), F.col("text").alias("scored"))
    return _score_only(spark, slim, model)


def _score_only(spark: SparkSession, docs: DataFrame, model: CharModels | None) -> DataFrame:
    found = identify(spark, docs, model, "scored", ["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", F.col("langid.lang").alias("lang_pred"), "langid.score",
                        "langid.cross_entropy", "langid.rejected")


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a model of its own labels does not reject."""
    found = identify(spark, docs, fit(spark, docs.select("doc_id", "text", "lang")))
    return found.filter("NOT langid.rejected").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
