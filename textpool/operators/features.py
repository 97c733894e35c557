"""Text features: vocabulary + fixed-length encoding, relational TF-IDF, Spark ML baseline.

Vocabularies and term tables hold everything by default and are joined on
their keys; sizes to cut them to are explicit parameters.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpool.functions.arrays import explode_values
from textpool.functions.scoring import argmax3
from textpool.operators import blocks as B
from textpool.operators.ranking import top_k, with_order_rank
from textpool.session import materialise, scratch_path

# Token patterns and encoder constants.
WORD_PATTERN = r"[\p{L}\p{N}_]+"
TFIDF_PATTERN = r"[\p{L}\p{N}_]{2,}"
MAX_LEN = 160
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
N_SPECIAL = 4
MIN_DF = 2
#: Terms that the learned baseline is fitted on, the most frequent first.
MAX_FEATURES = 80_000
#: Labelled rows in a task of the regressions at least, while few rows make few tasks.
FIT_TASK_ROWS = 2_500
N_CLASSES = 3
MARGIN_LIMIT = 100.0


def tokens(text_col: str = "text", pattern: str = WORD_PATTERN):
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(pattern), 0)


def build_vocabulary(docs: DataFrame, vocab_size: int | None = None, text_col: str = "text") -> DataFrame:
    """(token, token_id): all tokens by (count desc, token asc), ids from 4; only the first ``vocab_size`` when given.

    Counting is a partially aggregated shuffle on the token; the ids are a
    range-partitioned rank, so no task holds the vocabulary.
    """
    counts = explode_values(docs, [], tokens(text_col), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc("token")]
    ranked = with_order_rank(counts, order, "_r") if vocab_size is None else top_k(counts, vocab_size, order, rank_col="_r", desc_count="n")
    return ranked.select("token", (F.col("_r") + N_SPECIAL).cast("int").alias("token_id"))


def word_text(text_col: str = "text", pattern: str = WORD_PATTERN):
    """The tokens of a text joined by blanks, which no token holds; null for a null text."""
    return F.array_join(tokens(text_col, pattern), " ")


def encode_fixed(docs: DataFrame, vocab: DataFrame, id_col: str = "id", text_col: str = "text",
                 max_len: int = MAX_LEN) -> DataFrame:
    """M1: rows ``[CLS] ids… [SEP]`` of ``max_len`` ids, padded with 0; the mask marks real tokens.

    A text of more than ``max_len - 2`` tokens has as many windows as it needs
    (``window_no`` from 0), so nothing is cut off; window 0 is the row of an
    encoder that truncates. A text without tokens has one empty window.
    The distinct tokens of a block of texts meet the vocabulary in a join on
    the token; the block's texts are numbered with what comes back, so no
    token is a shuffled row of its own. Every row of ``docs`` is a text of its
    own, whether its id is repeated, null or neither.
    """
    body = max_len - 2
    texts = B.deal(docs, id_col, word_text(text_col), "encoder_words")

    def distinct(batches):
        for block, words in B.block_parts(batches):
            for part in B.cut(words):
                found = B.word_codes(part)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block, np.int64)), found], ["_block", "token"])

    def encode(texts: pa.Table, known: pa.Table) -> pa.Table:
        words, codes, rows = B.word_codes(texts.column("_words").combine_chunks())
        ids = B.looked_up(words, known, "token", "token_id", UNK_ID)[0][codes]
        sizes = np.bincount(rows, minlength=len(texts))
        windows = np.maximum(-(-sizes // body), 1)
        first, start = np.cumsum(windows) - windows, np.cumsum(sizes) - sizes
        pos = np.arange(len(rows)) - start[rows]
        at = first[rows] + pos // body
        real = np.bincount(at, minlength=windows.sum()) + 2
        grid = np.full((windows.sum(), max_len), PAD_ID, np.int32)
        grid[:, 0] = CLS_ID
        grid[at, pos % body + 1] = ids
        grid[np.arange(len(grid)), real - 1] = SEP_ID
        mask = (np.arange(max_len) < real[:, None]).astype(np.int32)
        row = np.repeat(np.arange(len(texts)), windows)
        ends = pa.array(np.arange(len(grid) + 1, dtype=np.int32) * max_len)
        return pa.table([texts.column(id_col).take(pa.array(row)), pa.array((np.arange(len(row)) - first[row]).astype(np.int32)),
                         pa.ListArray.from_arrays(ends, pa.array(grid.ravel())), pa.ListArray.from_arrays(ends, pa.array(mask.ravel()))], names)

    known = texts.mapInArrow(distinct, "_block long, token string").join(
        vocab.select("token", F.col("token_id").cast("int").alias("token_id")), "token").select("_block", "token", "token_id")
    schema = T.StructType([texts.schema[id_col], *T.StructType.fromDDL(
        "window_no int, input_ids array<int>, attention_mask array<int>").fields])
    names = schema.fieldNames()
    return texts.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(encode, schema)


def with_terms(df: DataFrame, text_col: str = "text", out: str = "terms") -> DataFrame:
    """Unigrams and bigrams of the lower-cased word tokens (length ≥ 2).

    Tokens are materialised once; bigrams zip the token array with itself
    shifted by one (linear, no per-element re-tokenisation).
    """
    t = df.withColumn("_tok", tokens(text_col, TFIDF_PATTERN))
    n = F.size("_tok")
    pairs = F.arrays_zip(F.slice("_tok", 1, F.greatest(n - 1, F.lit(0))).alias("a"),
                         F.slice("_tok", 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    bi = F.transform(pairs, lambda p: F.concat(p["a"], F.lit(" "), p["b"]))
    return t.withColumn(out, F.concat("_tok", F.when(n >= 2, bi).otherwise(F.array().cast("array<string>")))) \
        .drop("_tok")


def tfidf_relational(docs: DataFrame, id_col: str = "id", text_col: str = "text", min_df: int = MIN_DF,
                     max_features: int | None = None) -> DataFrame:
    """M2 (relational form): (id, term, tfidf) with smoothed idf ``ln((1+n)/(1+df)) + 1`` and L2 rows.

    Terms need ``df >= min_df``; with ``max_features`` only the most frequent
    (total count desc, term asc) are kept.  n = number of documents. Every
    row is a document of its own, whether its id is repeated or null.

    The tokens of the documents are dealt into blocks of bounded size and
    written to the shared folder, a block as one compressed row. A block's
    distinct terms leave it once, in compressed buckets by their hash, with the
    number of the block's documents that hold each. A bucket answers each block
    with the sums of its terms in the same order, as compressed numbers; there
    the documents are weighted. No row per document and term or per block and
    term is shuffled.
    """
    blocks = B.deal(docs, id_col, word_text(text_col, TFIDF_PATTERN), "tfidf_words", True)
    size = blocks.agg(F.sum(F.size("_ids")).alias("n"), F.sum("_bytes").alias("bytes")).first()
    n_docs, n_buckets = size["n"] or 0, max(1, math.ceil((size["bytes"] or 0) / B.BUCKET_BYTES))

    def count(batches):
        for batch in batches:
            for block, words in zip(batch.column("_block"), batch.column("_words"), strict=True):
                found = list(B.bucket_counts(B.strings(words.as_py()), n_buckets))
                if found:
                    columns = [pa.array([block.as_py()] * len(found)), *map(pa.array, zip(*found, strict=True))]
                    yield pa.RecordBatch.from_arrays(columns[:len(fields)], fields)

    def answers(found: pa.Table, df_of) -> pa.Table:
        sizes, codes, terms, (df,) = B.bucket_sums(found, "_df")
        df = df_of(terms, np.where(df >= min_df, df, 0))[codes]
        parts = [B.packed_numbers(x) for x in np.split(df, np.cumsum(sizes)[:-1])]
        return pa.table([found.column("_block"), found.column("_bucket"), pa.array(parts, pa.binary())], ["_block", "_bucket", "_df"])

    def sums(found: pa.Table) -> pa.Table:
        _, _, terms, (df, total) = B.bucket_sums(found, "_df", "_total")
        bucket = found.column("_bucket")[0].as_py()
        return pa.table([pa.array(np.full(len(terms), bucket, np.int64)), terms, pa.array(df), pa.array(total)], ["_bucket", "term", "df", "total"])

    def weigh(texts: pa.Table, known: pa.Table) -> pa.Table:
        ids = texts.column("_ids").combine_chunks().flatten()
        terms, codes, rows, starts = B.bucket_codes(B.strings(texts.column("_words")[0].as_py()), n_buckets)
        rows, codes, times = B.per_row(codes, rows, len(terms))
        df = np.zeros(len(terms), np.int64)
        for bucket, part in zip(known.column("_bucket").to_pylist(), known.column("_df"), strict=True):
            df[starts[bucket]:starts[bucket + 1]] = B.numbers(part.as_py())
        found = df > 0
        rows, codes, times = (x[found[codes]] for x in (rows, codes, times))
        w = times * (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0)[codes]
        norm = np.sqrt(np.bincount(rows, w * w, minlength=len(ids)))
        return pa.table([ids.take(pa.array(rows)), terms.take(pa.array(codes)), pa.array(w / norm[rows])], names)

    fields = ["_block", "_bucket", "_terms", "_df", "_total"][:4 if max_features is None else 5]
    counts = blocks.select("_block", "_words").mapInArrow(count, ", ".join(f"{c} {'long' if c in fields[:2] else 'binary'}" for c in fields))
    answer = "_block long, _bucket long, _df binary"
    if max_features is None:
        known = counts.groupBy("_bucket").applyInArrow(lambda t: answers(t, lambda terms, df: df), answer)
    else:
        vocab = counts.groupBy("_bucket").applyInArrow(sums, "_bucket long, term string, df long, total long").filter(F.col("df") >= min_df)
        vocab = top_k(vocab, max_features, [F.desc("total"), F.asc("term")], desc_count="total").select("_bucket", "term", "df")
        known = counts.groupBy("_bucket").cogroup(vocab.groupBy("_bucket")).applyInArrow(
            lambda t, v: answers(t, lambda terms, df: B.looked_up(terms, v, "term", "df", 0)[0]), answer)
    schema = T.StructType([T.StructField(id_col, blocks.schema["_ids"].dataType.elementType), *T.StructType.fromDDL("term string, tfidf double").fields])
    names = schema.fieldNames()
    return blocks.select("_block", "_ids", "_words").groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(weigh, schema)


class TextModel:
    """M3: a fitted text classifier over the classes 0..2; a scorer for ``scoring.apply_scorer``.

    Terms are built in the row, weights and terms (at most ``vocab_size``) travel
    with the plan: scoring has no shuffle and no Python worker.
    """

    def __init__(self, pipeline):
        self.pipeline = pipeline

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> TextModel:
        from pyspark.ml import PipelineModel
        return cls(PipelineModel.load(path))

    def score_frame(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df`` with ``l0, l1, l2``: the margins of the one-against-the-rest models. A null text counts as empty."""
        from pyspark.ml.functions import vector_to_array
        own = df.withColumn("_tm_text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
        out = self.pipeline.transform(with_terms(own, "_tm_text", "_tm_terms"))
        # a class that the training rows lack has no model
        known = {s.getRawPredictionCol() for s in self.pipeline.stages if s.hasParam("rawPredictionCol")}
        margin = lambda c: vector_to_array(f"_tm_raw{c}")[1] if f"_tm_raw{c}" in known else F.lit(-MARGIN_LIMIT)
        return out.select(*(F.col(f"`{c}`") for c in df.columns), *(margin(c).alias(f"l{c}") for c in range(N_CLASSES)))


def text_vocabulary(docs: DataFrame, vocab_size: int, min_df: int = MIN_DF, text_col: str = "text") -> DataFrame:
    """(term, df, total) of the ``vocab_size`` most frequent terms (total desc, term asc) in at least ``min_df`` rows.

    Terms are counted in slices of bounded size before the partially
    aggregated shuffle on the term, so a term leaves a slice once.
    """
    def count(batches):
        for batch in batches:
            for part in B.cut(batch.column(0)):
                terms, df, total = B.term_counts(part)
                yield pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(total)], ["term", "df", "total"])

    found = docs.select(word_text(text_col, TFIDF_PATTERN).alias("_words")).mapInArrow(count, "term string, df long, total long")
    counts = found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).filter(F.col("df") >= min_df)
    # the ranking reads its rows several times
    counts = materialise(docs.sparkSession, counts, "term_totals")
    return top_k(counts, vocab_size, [F.desc("total"), F.asc("term")], desc_count="total")


def fit_text_model(train: DataFrame, text_col: str = "text", label_col: str = "y", max_iter: int = 100, tol: float = 1e-4,
                   vocab_size: int = MAX_FEATURES, min_df: int = MIN_DF) -> TextModel:
    """M2 + M3: TF-IDF (1-2 grams, smoothed idf + 1, L2 rows) and a logistic regression of each class against the rest.

    A regression minimises ``|w|²/2`` plus the summed loss, where rows of its
    class weigh ``rows / (classes · rows of the class)`` and all others 1 (the
    reference solver's problem, but for the intercept, which is not penalised).
    Terms, document frequencies and the regressions come from all rows of
    ``train``. The rows' term counts are written once; each step of a
    regression is a job over blocks of them, which Spark holds in memory and on
    disk. ``vocab_size`` is the reference's number of terms; it bounds what the
    driver and each task hold.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    spark = train.sparkSession
    n = train.select(F.count(F.lit(1)).alias("n")).first()["n"]
    vocab = text_vocabulary(train, vocab_size, min_df, text_col).orderBy(F.desc("total"), "term").collect()  # ≤ vocab_size
    if not n or not vocab:
        raise ValueError("no terms to learn from")
    idf = Vectors.dense([math.log((1.0 + n) / (1.0 + v["df"])) + 1.0 for v in vocab])
    counter = CountVectorizerModel.from_vocabulary([v["term"] for v in vocab], inputCol="_tm_terms", outputCol="_tm_tf")
    stages = [counter, ElementwiseProduct(inputCol="_tm_tf", outputCol="_tm_tfidf", scalingVec=idf),
              Normalizer(inputCol="_tm_tfidf", outputCol="_tm_x", p=2.0)]
    labelled = train.select(label_col, F.coalesce(text_col, F.lit("")).alias("_tm_text")).filter(F.col(label_col).between(0, N_CLASSES - 1))
    path = scratch_path(spark, "fit_rows")
    # small whole numbers, which are written in a fraction of the weights' bytes
    counter.transform(with_terms(labelled, "_tm_text", "_tm_terms")).select(label_col, "_tm_tf").write.parquet(path)
    # every step of the fit is a job over these rows, so few rows go to few tasks
    rows = spark.read.parquet(path).coalesce(math.ceil(n / FIT_TASK_ROWS))
    counts = {r[label_col]: r["n"] for r in rows.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}  # ≤ 3 rows
    used = sum(counts.values())
    for stage in stages[1:]:
        rows = stage.transform(rows)
    for c, m in sorted(counts.items()):
        own = used / (len(counts) * m)
        # Spark divides the loss by the sum of the weights
        lr = LogisticRegression(featuresCol="_tm_x", labelCol="_tm_is", weightCol="_tm_w", rawPredictionCol=f"_tm_raw{c}",
                                probabilityCol="", predictionCol="", family="binomial", maxIter=max_iter, tol=tol,
                                regParam=1.0 / (own * m + used - m), standardization=False)
        is_c = F.col(label_col) == c
        stages.append(lr.fit(rows.withColumn("_tm_is", is_c.cast("double")).withColumn("_tm_w", F.when(is_c, own).otherwise(1.0))))
    # a fitted regression holds its summary and, through it, the session, which no task can be sent; a loaded one does not
    path = scratch_path(spark, "fitted_model")
    TextModel(Pipeline(stages=stages).fit(train)).save(path)
    return TextModel.load(path)


def tfidf_logreg(train: DataFrame, test: DataFrame, text_col: str = "text", label_col: str = "y", **options) -> DataFrame:
    """M2 + M3: the rows of ``test`` with ``prediction``, by a model fitted on ``train``, saved and loaded again.

    The class of the greatest margin wins, the smallest class on ties.
    """
    path = scratch_path(train.sparkSession, "text_model")
    fit_text_model(train, text_col, label_col, **options).save(path)
    scored = TextModel.load(path).score_frame(test, text_col)
    return scored.withColumn("prediction", argmax3(F.col("l0"), F.col("l1"), F.col("l2")))
