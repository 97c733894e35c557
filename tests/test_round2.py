"""Cases that the oracle's data does not hold: odd labels, several files, late bytes, other folders."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from textpool import session
from textpool.functions.labels import polarity_of
from textpool.operators import contract as C
from textpool.operators import pool as P
from textpool.operators import scoring as SC
from textpool.operators import validation as V
from textpool.operators.ranking import with_position
from textpool.sinks import writers as W
from textpool.sources import files as FS
from textpool.streaming import stream as ST

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_numbers_with_type_suffix_are_no_labels(spark):
    raw = ["1d", "2f", "2D", "1", " 2.9 ", "-0.5", "1e0", "nan", "Infinity", "0x1", "3", ".5", "neg"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    got = [r.p for r in df.select("i", polarity_of("v", None).alias("p")).orderBy("i").collect()]
    assert got == [None, None, None, 1, 2, 0, 1, None, None, None, None, 0, 0]


def test_total_is_told_from_null_labels(spark, tmp_path):
    df = spark.createDataFrame([("Positive",), (None,), (None,), ("Negative",)], "sentiment string")
    dist = SC.sentiment_distribution(df)
    rows = [(r.label, r["count"]) for r in dist.filter("is_total").collect()]
    assert rows == [("Total", 4)]
    assert {(r.label, r["count"]) for r in dist.filter("NOT is_total").collect()} == {("Positive", 1), ("Negative", 1), (None, 2)}
    W.stats_export(dist, str(tmp_path / "s"))
    back = [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()]
    assert [b[0] for b in back] == ["Total", "Negative", "Positive", None]


def test_null_sentiment_is_invalid(spark):
    df = spark.createDataFrame([(1, None), (2, "Neutral")], "id int, sentiment string")
    ok, bad = V.split_valid(df, V.sentiment_rules())
    assert [r.id for r in ok.collect()] == [2] and bad.collect()[0].reasons == ["sentiment_missing"]


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_positions_follow_the_files(spark, tmp_path, kind):
    path = str(tmp_path / "t")
    os.makedirs(path)
    for name, first, n in (("part-00000", 0, 10), ("part-00001", 10, 60_000)):
        one = spark.range(first, first + n, 1, 1)
        getattr(one.write, kind)(str(tmp_path / name))
        own = [f for f in os.listdir(tmp_path / name) if f.endswith(kind)][0]
        os.rename(tmp_path / name / own, f"{path}/{name}.{kind}")
    df = spark.read.parquet(path) if kind == "parquet" else spark.read.schema("id long").csv(path)
    got = with_position(df)
    assert got.columns == ["id", "position"]
    assert got.count() == 60_010 and got.filter("id <> position").count() == 0


def test_late_latin1_byte_and_files_of_two_encodings(spark, tmp_path):
    late = tmp_path / "late"
    late.mkdir()
    lines = [f"{i},plain" for i in range(12_000)] + ["12000,caf\u00e9 g\u00fcn"]
    (late / "a.csv").write_bytes(("id,text\n" + "\n".join(lines) + "\n").encode("latin-1"))
    df, enc, sep = FS.read_upload_csv(spark, str(late))
    assert (enc, sep) == ("ISO-8859-1", ",") and df.filter("id = '12000'").first().text == "caf\u00e9 g\u00fcn"
    (late / "b.csv").write_text("id,text\n20000,\u00fc\n", encoding="utf-8")
    df, enc, _ = FS.read_upload_csv(spark, str(late))
    assert enc == "mixed" and df.count() == 12_002
    assert {r.text for r in df.filter("id >= '12000' AND length(id) = 5 AND id in ('12000','20000')").collect()} == {"caf\u00e9 g\u00fcn", "\u00fc"}


def test_separators_and_splittable_reads(spark, tmp_path):
    for i, sep in enumerate("\t|;,"):
        f = tmp_path / f"{i}.csv"
        f.write_text(f"id{sep}text\n1{sep}a b\n")
        df, _, found = FS.read_upload_csv(spark, str(f))
        assert found == sep and df.columns == ["id", "text"] and df.first().text == "a b"
    big = tmp_path / "big.csv"
    big.write_text("id,text\n" + "".join(f"{i},{'x' * 60}\n" for i in range(40_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        assert FS.read_csv(spark, str(big)).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    quoted = tmp_path / "q.csv"
    quoted.write_text('id,text\n1,"two\nlines"\n')
    assert FS.read_csv(spark, str(quoted)).first().text == "two\nlines"


def test_column_roles():
    assert C.resolve_column(["Tweet", "TEXT"], C.SENTENCE_ALIASES, "Sentence") == "TEXT"
    assert C.resolve_column(["x", "Label", "polarity"], C.POLARITY_ALIASES, "Polarity") == "polarity"
    assert C.resolve_column(["metin", "Tweet"], C.CLI_TEXT_NAMES, order="column", exact_first="text") == "metin"
    for bad in (["a"], [], ["Text", "text"]):
        with pytest.raises(C.ColumnNotFound):
            C.resolve_column(bad, C.SENTENCE_ALIASES, "Sentence")


def test_guard_against_shared_sentences(spark, tmp_path):
    """A leaking split fails the job that writes it; a clean one goes through the guard unchanged."""
    clean = spark.createDataFrame([("a", 1, "train"), ("b", 1, "val"), ("c", 0, "test"), ("a", 1, "train")], "Sentence string, Polarity int, split string")
    P.guard_splits(clean).write.parquet(str(tmp_path / "clean"))
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 4
    leaking = clean.union(spark.createDataFrame([("b", 1, "test")], clean.schema))
    with pytest.raises(Exception, match="not disjoint on Sentence: 1 shared"):
        P.guard_splits(leaking).write.parquet(str(tmp_path / "leaking"))
    assert P.guard_splits(clean.limit(0)).count() == 0


def test_running_counts_without_and_with_several_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "id string, text string"
    assert ST.latest_counts(spark, str(tmp_path / "none"), "sentiment string, count long").count() == 0
    df = spark.createDataFrame([(str(i), f"text {i}, more") for i in range(12)], schema)
    df.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    counts = ST.run_distribution_stream(spark, stream, SC.ShapeScorer(), out, str(tmp_path / "ck"))
    assert counts.agg(F.sum("count")).first()[0] == 12
    assert len([x for x in os.listdir(out) if x.startswith("epoch=")]) >= 3


def test_no_private_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_workers_need_no_copy_of_the_package(tmp_path):
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from textpool.session import local_session\n"
            "s = local_session(cores=2, shuffle_partitions=2)\n"
            "from textpool.operators import scoring as SC\n"
            "df = s.createDataFrame([('1', 'a text, of words')], 'id string, text string')\n"
            "print('ROWS', SC.score_texts(df, SC.ShapeScorer()).count())\n")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
                         capture_output=True, text=True, timeout=180)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]
