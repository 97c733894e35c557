"""File sources: header CSV (all STRING), delimiter and encoding detection, lines, optional files.

Encoding and quoted line breaks are decided over the whole input by one
distributed pass each; only the header line is read to find the separator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpool.functions.arrays import explode_values
from textpool.functions.text import strip_ws
from textpool.operators.ranking import with_position
from textpool.operators.contract import empty_contract, strip_column_names
from textpool.session import materialise
from textpool.sources import quoted_csv

UTF8, LATIN1 = "UTF-8", "ISO-8859-1"
MIXED = "mixed"
SEPARATORS = (";", "\t", "|", ",")


def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str = UTF8,
             quoted_breaks: bool | None = None, position: str | None = None) -> DataFrame:
    """Header CSV, every column STRING (no inference), names trimmed; ``position`` names a column for the record's place.

    ``quoted_breaks``: fields may hold line breaks, so records are cut out of
    the files' pieces in a second pass (``quoted_csv``); by default a pass over
    the lines finds out whether they do. Either way a file is read by as many
    tasks as it has pieces.
    """
    states = None
    if quoted_breaks is not False:
        quoted_csv.pin_splits(spark)
        states = materialise(spark, quoted_csv.piece_states(spark, path, sep), "csv_pieces")  # one row per piece
        quoted_breaks = quoted_breaks or bool(states.filter("breaks").limit(1).count())
    if quoted_breaks:
        return strip_column_names(quoted_csv.read_quoted_csv(spark, path, sep, encoding, states, position))
    df = (spark.read.option("header", True).option("escape", '"').option("inferSchema", False).option("sep", sep)
          .option("encoding", encoding).csv(path))
    return strip_column_names(df if position is None else with_position(df, position))


def _fields_outside_quotes(line: str, sep: str) -> int:
    n, quoted = 1, False
    for ch in line:
        if ch == '"':
            quoted = not quoted
        elif ch == sep and not quoted:
            n += 1
    return n


def detect_separator(spark: SparkSession, path: str | Sequence[str], encoding: str = UTF8) -> str:
    """The separator that cuts the header into most columns (``;``, tab, ``|``, ``,`` on ties); ``,`` for one column."""
    first = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    header = (first[0][0] if first else "") or ""
    best = max(SEPARATORS, key=lambda s: _fields_outside_quotes(header, s))
    return best if _fields_outside_quotes(header, best) > 1 else ","


def files_by_encoding(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """S3: the input's files without and with a line anywhere that is not valid UTF-8 (driver rows: file names only)."""
    lines = spark.read.text(path).select(F.is_valid_utf8("value").alias("ok"), F.col("_metadata.file_path").alias("file"))
    rows = lines.groupBy("file").agg(F.bool_and("ok").alias("ok")).collect()
    return sorted(r.file for r in rows if r.ok), sorted(r.file for r in rows if not r.ok)


def read_upload_csv(spark: SparkSession, path: str, position: str | None = None) -> tuple[DataFrame, str, str]:
    """S2 + S3: every file in its own encoding, UTF-8 or else Latin-1. Returns (df, encoding or "mixed", separator).

    ``position`` names a column with the record's place; of mixed encodings, the UTF-8 files come first.
    """
    good, bad = files_by_encoding(spark, path)
    if not bad or not good:
        encoding = LATIN1 if bad else UTF8
        sep = detect_separator(spark, path, encoding)
        return read_csv(spark, path, sep, encoding, position=position), encoding, sep
    sep = detect_separator(spark, good, UTF8)
    first, second = read_csv(spark, good, sep, UTF8, position=position), read_csv(spark, bad, sep, LATIN1, position=position)
    if position is not None:
        second = second.withColumn(position, F.col(position) + first.select(F.count(F.lit(1))).scalar())
    return first.unionByName(second), MIXED, sep


def lines_to_items(df: DataFrame, text_col: str = "text", max_items: int | None = None) -> DataFrame:
    """Split each text on CRLF/LF, strip, keep lines of ≥ 2 chars (the first ``max_items`` per text, if given);
    ``line_id`` is the position among kept lines (0-based)."""
    lines = F.transform(F.split(F.col(text_col), r"\r?\n"), lambda s: strip_ws(s))
    kept = F.filter(lines, lambda s: F.length(s) >= 2)
    if max_items is not None:
        kept = F.slice(kept, 1, max_items)
    return explode_values(df, ["*"], kept, "line", pos_alias="line_id").drop(text_col)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def optional_contract_source(spark: SparkSession, path: str, reader) -> DataFrame:
    """A missing file yields an empty contract frame (so unions pass the input through)."""
    if not path_exists(spark, path):
        return empty_contract(spark)
    return reader(spark, path)
