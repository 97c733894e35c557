"""M1 with sub-words: texts to windows of piece ids, by a vocabulary that is given, never trained here.

An encoder is a factory, called once per Python worker, for a function from a
text to its ids and back. ``LongestMatch`` walks a trie over a table of
pieces; ``RankedMerges`` applies the ranked byte merges of a vocabulary file,
which is read on the driver and travels with the plan.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpool.operators.blocks import cut
from textpool.operators.features import MAX_LEN

#: Fixed value: how the byte-level vocabularies cut a text before merging.
PIECE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of texts, and rows of ids, that a worker turns into Python objects at a time.
SLICE_BYTES = 500_000
SLICE_ROWS = 200

Codec = tuple[Callable[[str], Iterable[int]], Callable[[Iterable[int]], str]]


class LongestMatch:
    """At each place the longest piece of the table; its pieces must hold every single byte that texts may have."""

    def __init__(self, pieces: dict[bytes, int]):
        self.pieces = dict(pieces)

    def __call__(self) -> Codec:
        root: dict = {}
        for piece, number in self.pieces.items():
            node = root
            for byte in piece:
                node = node.setdefault(byte, {})
            node[-1] = number
        back = {number: piece for piece, number in self.pieces.items()}

        def encode(text: str) -> Iterator[int]:
            data, pos = text.encode(), 0
            while pos < len(data):
                node, found, end = root, None, pos
                for at in range(pos, len(data)):
                    node = node.get(data[at])
                    if node is None:
                        break
                    if -1 in node:
                        found, end = node[-1], at + 1
                if found is None:
                    raise ValueError(f"no piece for byte {data[pos]}")
                yield found
                pos = end

        return encode, lambda ids: b"".join(back[i] for i in ids).decode()


class RankedMerges:
    """Byte pairs of a text's parts merged in the order of their ranks (one ``base64 rank`` line per piece in ``path``)."""

    def __init__(self, path: str, pattern: str = PIECE_PATTERN):
        with open(path, "rb") as f:
            self.lines = f.read()
        self.pattern = pattern

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, self.lines.splitlines())}

    def __call__(self) -> Codec:
        import tiktoken
        encoding = tiktoken.Encoding("given", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})
        return encoding.encode_ordinary, encoding.decode


def subword_ids(text: Column, encoder: Callable[[], Codec]) -> Column:
    """All ids of each whole text; a null text has none. A worker holds the ids of a slice of a batch at a time."""
    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, _ = encoder()
        for batch in batches:
            for texts in cut(batch, SLICE_BYTES):
                ids, sizes = array("i"), [0]
                for t in texts:
                    if t.is_valid:
                        ids.extend(encode(t.as_py()))
                    sizes.append(len(ids))
                yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.array(ids, np.int32)))

    return run(text)


def subword_text(ids: Column, encoder: Callable[[], Codec]) -> Column:
    """The text of each list of ids, one list at a time."""
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, decode = encoder()
        for batch in batches:
            for begin in range(0, len(batch), SLICE_ROWS):
                yield pa.array([decode(x.as_py()) if x.is_valid else None for x in batch.slice(begin, SLICE_ROWS)], pa.string())

    return run(ids)


def encode_subwords(docs: DataFrame, encoder: Callable[[], Codec], cls_id: int, sep_id: int, pad_id: int, id_col: str = "id",
                    text_col: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """M1: (id, window_no, input_ids, attention_mask), windows ``[cls] ids [sep]`` padded to ``max_len``.

    A text has as many windows as its ids need, one if it has none; window 0
    is the row of an encoder that truncates. Nothing is shuffled, so rows that
    share an id stay apart.
    """
    body = max_len - 2
    coded = docs.select(F.col(id_col), subword_ids(F.col(text_col), encoder).alias("_ids"))
    last = F.greatest(F.floor((F.size("_ids") - 1) / body), F.lit(0)).cast("int")
    cut = coded.select(id_col, "_ids", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    ids = F.concat(F.array(F.lit(cls_id)), F.slice("_ids", F.col("window_no") * body + 1, F.lit(body)), F.array(F.lit(sep_id)))
    row = cut.select(id_col, "window_no", ids.alias("_s"))
    pad = F.lit(max_len) - F.size("_s")
    return row.select(id_col, "window_no", F.concat("_s", F.array_repeat(F.lit(pad_id), pad)).alias("input_ids"),
                      F.concat(F.array_repeat(F.lit(1), F.size("_s")), F.array_repeat(F.lit(0), pad)).alias("attention_mask"))
