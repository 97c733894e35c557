"""Parallel CSV with line breaks in quoted fields, against the reader that takes a file as a whole."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from textpool.sources import files, quoted_csv


def odd_csv(rng, n, eol, sep=","):
    """Rows whose fields hold breaks, quotes, separators; unquoted fields with a stray quote; empty lines."""
    out = io.StringIO()
    out.write(sep.join(["id", "a b", '"two\nlines"']) + eol)
    writer = csv.writer(out, delimiter=sep, lineterminator=eol, quoting=csv.QUOTE_MINIMAL)
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            out.write(f'{i}{sep}5" pipe{sep}a "quoted" word{eol}')
        elif kind == 1:
            out.write(eol)
        else:
            words = [rng.choice(["x", '"', "\n", sep, '""', "\n\n", f'{sep}"', '"\n', "é", "word " * 5, f'"{sep}']) for _ in range(rng.randrange(9))]
            writer.writerow([i, "".join(words), rng.choice(["", "plain", "".join(reversed(words))])])
    return out.getvalue()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_carriage_returns_end_records_but_stay_in_fields(spark, tmp_path):
    text = odd_csv(random.Random(4), 80, "\r\n")
    (tmp_path / "f.csv").write_bytes(text.encode())
    want = [tuple(f or None for f in r) for r in list(csv.reader(io.StringIO(text, newline="")))[1:] if r]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 333)
    try:
        assert rows(files.read_csv(spark, str(tmp_path))) == sorted(want, key=repr)
        placed = files.read_csv(spark, str(tmp_path), position="place").collect()  # and in the order of the file
        assert [tuple(r)[:-1] for r in sorted(placed, key=lambda r: r.place)] == want and {r.place for r in placed} == set(range(len(want)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("eol,sep,piece", [("\n", ",", 97), ("\n", ";", 1000), ("\n", ",", 1 << 20)])
def test_equals_the_whole_file_read(spark, tmp_path, eol, sep, piece):
    rng = random.Random(piece)
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_bytes(odd_csv(rng, 60, eol, sep).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
    try:
        got = files.read_csv(spark, str(tmp_path), sep)
        want = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(str(tmp_path)))
        assert got.columns == [c.strip() for c in want.columns] and rows(got) == rows(want)
        assert piece > 1000 or got.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_record_over_many_pieces_and_a_stray_quote(spark, tmp_path):
    long = "\n".join(f'line {i}, with ""quotes""' for i in range(2000))
    (tmp_path / "f.csv").write_text(f'id,t\n1,"{long}"\n2,5" pipe\n3,"{long}"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        got = {r.id: r.t for r in files.read_csv(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"1": long.replace('""', '"'), "2": '5" pipe', "3": long.replace('""', '"')}


def test_stray_quotes_alone_need_no_second_pass(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id,t\n1,5" pipe\n2,"closed, here"\n')
    assert not quoted_csv.piece_states(spark, str(tmp_path)).filter("breaks").count()
    assert rows(files.read_csv(spark, str(tmp_path))) == [("1", '5" pipe'), ("2", "closed, here")]


def test_header_only_and_latin1(spark, tmp_path):
    (tmp_path / "h.csv").write_text('id,"t\nu"\n')
    assert files.read_csv(spark, str(tmp_path / "h.csv")).collect() == []
    (tmp_path / "l.csv").write_bytes('id,t\n1,"é\nü"\n'.encode("latin-1"))
    assert files.read_csv(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").collect()[0].t == "é\nü"


@pytest.mark.parametrize("line,quoted,want", [(b"a,b", False, False), (b'"a', False, True), (b'a,"b', False, True), (b'a"b', False, False),
                                              (b'"a,"', False, False), (b'x",y', True, False), (b'x"",y', True, True), (b'x","y', True, True),
                                              (b"", True, True), (b"", False, False), (b'"a"b,"c', False, True), (b'""', False, False)])
def test_line_states(line, quoted, want):
    assert quoted_csv.ends_quoted(line, quoted, b",") is want
