"""CSV whose quoted fields hold line breaks, read in parallel.

A file is cut into pieces at line ends, wherever those lie. Whether a piece
begins inside a quoted field depends on everything before it, so one pass
follows every piece from both states and notes where each ends; composing
these answers in file order, one row per piece, gives every piece its state.
A second pass cuts the pieces into records. Records that go on over the end
of a piece come out as fragments, at most two a piece, and are put together
by file order. No task holds more than a piece, or the pieces of one record.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = ["file", "start", "size"]
WHOLE, HEAD, THROUGH, TAIL = 0, 1, 2, 3


def ends_quoted(line: bytes, quoted: bool, sep: bytes) -> bool:
    """Whether a line ends inside a quoted field, begun inside one (``quoted``) or at a record's start.

    A quote opens a field only as its first character; inside, two quotes
    stand for one; after the closing one everything up to the separator
    belongs to the field.
    """
    pos = 0
    if not quoted:
        if line[:1] != b'"':
            pos = line.find(sep + b'"')
            if pos < 0:
                return False
            pos += 1
        pos += 1
    while True:  # pos: first byte inside a quoted field
        pos = line.find(b'"', pos)
        while pos >= 0 and line[pos + 1:pos + 2] == b'"':
            pos = line.find(b'"', pos + 2)
        if pos < 0:
            return True
        pos = line.find(sep, pos + 1)
        if pos >= 0 and line[pos + 1:pos + 2] != b'"':
            pos = line.find(sep + b'"', pos + 1)
        if pos < 0:
            return False
        pos += 2


def pin_splits(spark: SparkSession) -> None:
    """Both passes must cut the files alike: the number that Spark divides small inputs by no longer follows the executors."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, spark.sparkContext.defaultParallelism)


def _lines(spark: SparkSession, path) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), meta["file_block_length"].alias("size"),
        F.col("value").cast("binary").alias("line"))


def piece_states(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """(file, start, size, from_plain, from_quoted, breaks): where each piece ends, from both states it may begin in.

    ``breaks``: some line of it, begun at a record's start, ends inside a
    quoted field. If no piece has one, no record goes over a line's end.
    Only lines that hold a quote go to Python.
    """
    mark = sep.encode()

    def follow(batches):
        done, at, state = {}, None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for *piece, line in zip(*columns, strict=True):
                if piece != at:
                    at = piece
                    state = done.setdefault(tuple(piece), [False, True, False])
                if line is not None:
                    opens = ends_quoted(line, False, mark)
                    closes = ends_quoted(line, True, mark)
                    state[0], state[1] = (closes if state[0] else opens), (closes if state[1] else opens)
                    state[2] = state[2] or opens
        rows = [dict(zip([*PIECE, "from_plain", "from_quoted", "breaks"], [*k, *v], strict=True)) for k, v in done.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("from_plain", pa.bool_()),
                ("from_quoted", pa.bool_()), ("breaks", pa.bool_())]))

    held = _lines(spark, path).withColumn("line", F.when(F.contains(F.col("line"), F.lit(b'"')), F.col("line")))
    return held.mapInArrow(follow, "file string, start long, size long, from_plain boolean, from_quoted boolean, breaks boolean")


def _begin_quoted(states: DataFrame) -> DataFrame:
    """(file, start, size, quoted): the state that each piece begins in. A file's pieces are one small row."""
    piece = F.struct("start", "size", "from_plain", "from_quoted")
    files = states.groupBy("file").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    empty = F.array().cast("array<struct<start:bigint,size:bigint,quoted:boolean>>")
    first = F.struct(F.lit(False).alias("quoted"), empty.alias("seen"))

    def step(acc, x):
        seen = F.struct(x["start"].alias("start"), x["size"].alias("size"), acc["quoted"].alias("quoted"))
        return F.struct(F.when(acc["quoted"], x["from_quoted"]).otherwise(x["from_plain"]).alias("quoted"),
                        F.concat(acc["seen"], F.array(seen)).alias("seen"))

    return files.select("file", F.inline(F.aggregate("pieces", first, step)["seen"]))


def _cut(lines: DataFrame, sep: str, whole: bool) -> DataFrame:
    """(file, start, kind, nth, first, record) of lines (file, start, size, line, quoted): whole records, or the pieces' fragments.

    ``nth`` counts the piece's own records before this one; ``first``: no
    record of the file lies before it.
    """
    mark = sep.encode()
    names = ["file", "start", "kind", "nth", "first", "record"]
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("nth", pa.int64()), ("first", pa.bool_()),
                        ("record", pa.binary())])

    def cut(batches):
        at, parts, quoted, carried, first, nth = None, [], False, False, False, 0

        def fragment(kind):
            return dict(zip(names, [at[0], at[1], kind, nth, first and kind == TAIL, b"\n".join(parts)], strict=True))

        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for file, start, size, line, begins in zip(*columns, strict=True):
                if (file, start, size) != at:
                    if parts and not whole:
                        out.append(fragment(THROUGH if carried else TAIL))
                    at, parts, quoted, carried, first, nth = (file, start, size), [], begins, begins, start == 0, 0
                parts.append(line)
                quoted = ends_quoted(line, quoted, mark) if quoted or b'"' in line else False
                if not quoted:
                    if carried:
                        if not whole:
                            out.append(fragment(HEAD))
                    else:
                        record = b"\n".join(parts)
                        if record not in (b"", b"\r"):
                            if whole:
                                out.append({"file": file, "start": start, "kind": WHOLE, "nth": nth, "first": first, "record": record})
                            first, nth = False, nth + 1
                    parts, carried = [], False
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if parts and not whole:
            yield pa.RecordBatch.from_pylist([fragment(THROUGH if carried else TAIL)], schema=schema)

    return lines.mapInArrow(cut, "file string, start long, kind int, nth long, first boolean, record binary")


def _decoded(record: Column, encoding: str) -> Column:
    return record.cast("string") if encoding.upper() == "UTF-8" else F.decode(record, encoding)


def _joined(fragments: DataFrame, encoding: str) -> DataFrame:
    """(file, start, nth, first, record): fragments of one file put together in order, from each tail to the next."""
    order = Window.partitionBy("file").orderBy("start", "kind")
    numbered = fragments.withColumn("tail", F.sum((F.col("kind") == TAIL).cast("long")).over(order))
    folded = numbered.groupBy("file", "tail").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "nth", "first", "record"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: _decoded(p["record"], encoding)), "\n")
    begin = F.col("parts")[0]  # its tail: a file never begins inside a field
    return folded.select("file", begin["start"].alias("start"), begin["nth"].alias("nth"), begin["first"].alias("first"), text.alias("record"))


def read_records(spark: SparkSession, path: str | Sequence[str], states: DataFrame, sep: str = ",",
                 encoding: str = "UTF-8") -> DataFrame:
    """(file, start, nth, record): the records of the files without their headers, each with the piece that it begins in.

    ``states`` come from ``piece_states`` of the same files.
    """
    begins = _begin_quoted(states)
    # one row per piece: input size over spark.sql.files.maxPartitionBytes
    lines = _lines(spark, path).join(F.broadcast(begins), PIECE, "left").select(
        *PIECE, "line", F.coalesce("quoted", F.raise_error(F.lit("the input was cut differently in the second pass"))).alias("quoted"))
    whole = _cut(lines, sep, True).select("file", "start", "nth", "first", _decoded(F.col("record"), encoding).alias("record"))
    return whole.union(_joined(_cut(lines, sep, False), encoding)).filter("NOT first").select(
        "file", "start", (F.col("nth") - F.when(F.col("start") == 0, 1).otherwise(0)).alias("nth"),
        F.regexp_replace("record", r"\r$", "").alias("record"))


def record_positions(records: DataFrame) -> DataFrame:
    """``records`` with ``position``, from 0, by file path, piece and place in it. Records are counted per piece."""
    counts = records.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))  # one row per piece
    offsets = counts.select("file", "start", F.coalesce(before, F.lit(0)).alias("offset"))
    return records.join(F.broadcast(offsets), ["file", "start"]).withColumn("position", F.col("offset") + F.col("nth"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`{}` STRING".format(f.name.replace("`", "``")) for f in schema.fields)


def read_quoted_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str = "UTF-8",
                    states: DataFrame | None = None, position: str | None = None) -> DataFrame:
    """Header CSV with line breaks in quoted fields, every column STRING, in as many tasks as the files have pieces.

    ``position`` names a column with the record's place in the input.
    """
    if states is None:
        pin_splits(spark)
        states = piece_states(spark, path, sep)
    options = {"sep": sep, "escape": '"', "multiLine": "true"}
    header = spark.read.options(**options, header="true", inferSchema="false", encoding=encoding).csv(path).schema
    records = read_records(spark, path, states, sep, encoding)
    if position is None:
        return records.select(F.from_csv("record", _ddl(header), options).alias("_r")).select("_r.*")
    return record_positions(records).select(F.from_csv("record", _ddl(header), options).alias("_r"), "position") \
        .select("_r.*", F.col("position").alias(position))
