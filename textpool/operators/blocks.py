"""Texts in blocks of bounded size, so that a word or term travels once per block and not once per text.

Words are tokens without blanks, joined by one blank in a string column: that
is the whole text's tokens at the size of the text. Inside a block they are
numbered with Arrow and counted with numpy; between blocks Spark groups and joins.

A packed block is one row. Its distinct terms leave it in buckets by their
hash, sorted and compressed; what a bucket says of them comes back as numbers
in the same order, so no term travels twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from textpool.session import scratch_path

#: Bytes of words in a block, up to one text more; a row counts ``ROW_BYTES`` beside its own.
BLOCK_BYTES = 8_000_000
ROW_BYTES = 200
#: Bytes of words for each bucket of terms: what a task holds of a bucket grows with them, not with the input.
BUCKET_BYTES = 16_000_000
#: Bytes of a row group of packed blocks: readers hold one.
GROUP_BYTES = 16 << 20
_PART_BITS = 33


def _starts(values: pa.Array, before: int = 0) -> np.ndarray:
    """Bytes before each row, ``before`` those of earlier batches; the last entry is the total."""
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES
    return before + np.concatenate([[0], np.cumsum(sizes)])


def cut(values: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """The strings in order, in slices of about ``limit`` bytes."""
    numbers = _starts(values)[:-1] // limit
    edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(values)]
    for begin, end in zip(edges, edges[1:], strict=False):
        if end > begin:
            yield values.slice(begin, end - begin)


def deal(docs: DataFrame, id_col: str, words: Column, name: str, packed: bool = False, limit: int = BLOCK_BYTES) -> DataFrame:
    """(_block, id, _words) of every row, written once to the shared folder: rows that follow each other share a block.

    With ``packed``, a row is a whole block: (_block, _bytes, _ids, _words), the words as ``packed_strings``.
    """
    own = docs.select(id_col).schema[0]
    schema = T.StructType([T.StructField("_block", T.LongType()), own, T.StructField("_words", T.StringType())])
    whole = T.StructType([T.StructField("_block", T.LongType()), T.StructField("_bytes", T.LongType()),
                          T.StructField("_ids", T.ArrayType(own.dataType)), T.StructField("_words", T.BinaryType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before = TaskContext.get().partitionId() << _PART_BITS, 0
        for batch in batches:
            starts = _starts(batch.column(1), before)
            before = int(starts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(first + starts[:-1] // limit), *batch.columns], names)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, texts = (pa.concat_arrays([p.column(i) for p in parts]) for i in (1, 2))
        return pa.RecordBatch.from_arrays([
            parts[0].column(0)[:1], pa.array([int(_starts(texts)[-1])]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([packed_strings(texts)], pa.binary())], whole.fieldNames())

    def run_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in run(batches):
            numbers = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if held and end > begin and held[0].column(0)[0].as_py() != numbers[begin]:
                    yield block(held)
                    held = []
                if end > begin:
                    held.append(batch.slice(begin, end - begin))
        if held:
            yield block(held)

    path, kind = scratch_path(docs.sparkSession, name), whole if packed else schema
    out = docs.select(id_col, words.alias("_words")).mapInArrow(run_packed if packed else run, kind).write
    (out.option("parquet.block.size", GROUP_BYTES) if packed else out).parquet(path, compression="zstd")
    return docs.sparkSession.read.schema(kind).parquet(path)


def squeezed(data: bytes | pa.Buffer) -> bytes:
    """The bytes, compressed, behind their number."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> pa.Buffer:
    return pa.py_buffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def packed_strings(values: pa.Array) -> bytes:
    """One or more strings without line breaks; a null becomes an empty one."""
    rows = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pc.fill_null(values, ""))
    return squeezed(pc.binary_join(rows, "\n")[0].as_buffer())


def strings(data: bytes) -> pa.Array:
    """What ``packed_strings`` or ``packed_buckets`` packed."""
    text = unsqueezed(data)
    lines = pa.StringArray.from_buffers(1, pa.array([0, len(text)], pa.int32()).buffers()[1], text)
    return pc.split_pattern(lines, "\n").flatten()


def packed_numbers(values: np.ndarray) -> bytes:
    """64-bit whole numbers by byte: the high ones are mostly zeros."""
    return squeezed(np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(unsqueezed(data), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def block_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """(block, words) of the runs of equal blocks in the batches; a block may come in several parts."""
    for batch in batches:
        blocks = batch.column("_block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
        for begin, end in zip(edges, edges[1:], strict=False):
            if end > begin:
                yield int(blocks[begin]), batch.column("_words").slice(begin, end - begin)


def word_codes(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some rows; of every occurrence in order, its word's number and its row."""
    lists = pc.split_pattern(pc.fill_null(words, ""), " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    held = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(held)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(words)), sizes)[held]


def _paired(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of neighbours as two codes below ``n``; of every pair in order, its number and its row."""
    at = np.flatnonzero(rows[1:] == rows[:-1])
    pairs, number = np.unique(codes[at] * n + codes[at + 1], return_inverse=True)
    return pairs // n, pairs % n, number, rows[at]


def _with_pairs(single: pa.Array, left: np.ndarray, right: np.ndarray) -> pa.Array:
    double = pc.binary_join_element_wise(single.take(pa.array(left)), single.take(pa.array(right)), " ")
    return pa.concat_arrays([single, double])


def term_codes(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As ``word_codes``, of the words and of the pairs of neighbouring words."""
    single, codes, rows = word_codes(words)
    left, right, number, of = _paired(codes, rows, max(len(single), 1))
    return _with_pairs(single, left, right), np.concatenate([codes, len(single) + number]), np.concatenate([rows, of])


def bucket_codes(words: pa.Array, n_buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """As ``term_codes``, the terms bucket by bucket; then, where each bucket begins and the last one ends.

    A term's bucket is a hash of its words, the same in each block. In a bucket,
    words are sorted and then pairs by their words: neighbours share their beginnings.
    """
    single, codes, rows = word_codes(words)
    order = pc.sort_indices(single).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    single, codes = single.take(pa.array(order)), place[codes]
    left, right, number, of = _paired(codes, rows, max(len(single), 1))
    own = pd.util.hash_array(single.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    mixed = np.concatenate([own, own[left] * np.uint64(0x9E3779B97F4A7C15) + own[right]])  # wraps around
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    bucket = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(n_buckets)).astype(np.uint16 if n_buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    starts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n_buckets))])
    terms = _with_pairs(single, left, right).take(pa.array(order))
    return terms, place[np.concatenate([codes, len(single) + number])], np.concatenate([rows, of]), starts


def packed_buckets(terms: pa.Array, starts: np.ndarray) -> list[bytes]:
    """The terms of each bucket, none of which is empty."""
    return [squeezed(x.as_buffer()) for x in pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), terms), "\n")]


def per_row(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) of occurrences, and how often each occurs; codes are below ``n``."""
    keys, times = np.unique(rows * max(n, 1) + codes, return_counts=True)
    return keys // max(n, 1), keys % max(n, 1), times


def _counted(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each code, the number of rows that hold it, and of its occurrences."""
    return np.bincount(per_row(codes, rows, n)[1], minlength=n), np.bincount(codes, minlength=n)


def term_counts(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of some rows, the number of rows that hold each, and of its occurrences."""
    terms, codes, rows = term_codes(words)
    return terms, *_counted(codes, rows, len(terms))


def bucket_counts(words: pa.Array, n_buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Of each bucket that has terms: its number, the terms, and packed their rows and occurrences as in ``term_counts``."""
    terms, codes, rows, starts = bucket_codes(words, n_buckets)
    df, total = _counted(codes, rows, len(terms))
    held = np.flatnonzero(np.diff(starts))
    edges = np.append(starts[held], len(terms))
    for i, (bucket, found) in enumerate(zip(held.tolist(), packed_buckets(terms, edges), strict=True)):
        part = slice(edges[i], edges[i + 1])
        yield bucket, found, packed_numbers(df[part]), packed_numbers(total[part])


def bucket_sums(found: pa.Table, *columns: str) -> tuple[list[int], np.ndarray, pa.Array, list[np.ndarray]]:
    """The blocks' counts of one bucket together: terms in each block; of every term there, its number; the terms; each column's sums."""
    parts = [strings(x.as_py()) for x in found.column("_terms")]
    coded = pa.chunked_array(parts, pa.string()).combine_chunks().dictionary_encode()
    codes, sums = coded.indices.to_numpy(zero_copy_only=False), []
    for name in columns:
        sums.append(np.zeros(len(coded.dictionary), np.int64))
        np.add.at(sums[-1], codes, np.concatenate([numbers(x.as_py()) for x in found.column(name)]))
    return [len(x) for x in parts], codes, coded.dictionary, sums


def looked_up(words: pa.Array, known: pa.Table, key: str, value: str, default: float) -> tuple[np.ndarray, np.ndarray]:
    """``value`` of each word in the table of known ones (``default`` if it is none), and whether it is one."""
    at = pc.index_in(words, value_set=known.column(key).combine_chunks())
    found = pc.is_valid(at).to_numpy(zero_copy_only=False)
    values = known.column(value).combine_chunks().to_numpy(zero_copy_only=False)
    out = np.full(len(words), default, dtype=values.dtype)
    out[found] = values[at.drop_null().to_numpy(zero_copy_only=False)]
    return out, found
