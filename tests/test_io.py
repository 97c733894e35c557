import os
import tempfile

from pyspark.sql import functions as F

from textpool.operators import contract as C
from textpool.sinks import writers as W
from textpool.sources import files as FS


def _tmp():
    return tempfile.mkdtemp(prefix="textpool-io-")


def test_separator_and_encoding_detection(spark):
    d = _tmp()
    with open(os.path.join(d, "semi.csv"), "w", encoding="utf-8") as f:
        f.write("id;Text\n1;héllo, world\n2;\"multi\nline\"\n")
    df, enc, sep = FS.read_upload_csv(spark, os.path.join(d, "semi.csv"))
    assert (enc, sep) == ("UTF-8", ";")
    assert sorted(r.Text for r in df.collect()) == ["héllo, world", "multi\nline"]
    with open(os.path.join(d, "latin.csv"), "w", encoding="latin-1") as f:
        f.write("text,label\ncafé crème,pos\n")
    df, enc, sep = FS.read_upload_csv(spark, os.path.join(d, "latin.csv"))
    assert (enc, sep) == ("ISO-8859-1", ",") and df.collect()[0].text == "café crème"
    with open(os.path.join(d, "bom.csv"), "w", encoding="utf-8-sig") as f:
        f.write("text,label\nx,1\n")
    df, enc, _ = FS.read_upload_csv(spark, os.path.join(d, "bom.csv"))
    assert enc == "UTF-8" and df.columns == ["text", "label"]


def test_lines_to_items(spark):
    df = spark.createDataFrame([(1, "a\r\n  bb  \n\nccc\n x \n" + "\n".join(f"l{i}" for i in range(10)))], "doc int, text string")
    out = FS.lines_to_items(df, max_items=4).collect()
    assert [(r.line_id, r.line) for r in out] == [(0, "bb"), (1, "ccc"), (2, "l0"), (3, "l1")]


def test_optional_source_and_csv_roundtrip(spark):
    d = _tmp()
    base = spark.createDataFrame([("a", 1)], "Sentence string, Polarity int")
    miss = FS.optional_contract_source(spark, os.path.join(d, "nope.csv"), lambda s, p: C.normalise_contract(FS.read_csv(s, p)))
    assert base.unionByName(miss).count() == 1
    raw = spark.createDataFrame([("  quoted \"x\", y ", "positive"), ("line1\nline2", "neg")], "` Tweet ` string, label string")
    W.write_csv(raw, os.path.join(d, "rt"))
    back = C.normalise_contract(FS.read_csv(spark, os.path.join(d, "rt")))
    assert sorted(map(tuple, back.collect())) == [('line1\nline2', 0), ('quoted "x", y', 2)]


def test_run_partitioned_overwrite(spark):
    d = os.path.join(_tmp(), "runs")
    df = spark.range(3)
    W.write_run(df, d, "a")
    W.write_run(df, d, "b")
    W.write_run(spark.range(5), d, "a")
    got = spark.read.parquet(d)
    assert {r.run_name: r["count"] for r in got.groupBy("run_name").count().collect()} == {"a": 5, "b": 3}
    assert got.filter(F.col("run_name") == "b").count() == 3
