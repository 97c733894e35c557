"""Pages by key ranges and substring search by trigrams, against the whole table; and how many files they read."""

import random

import pytest
from pyspark.sql import functions as F

from textpool.operators import explore as X
from textpool.operators.result_index import ResultIndex


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    rows = [(f"r{i}", rng.choice([None, "", "Tie", "ties Ünï " + "ab" * rng.randrange(5)]) if i % 9 == 0
             else "".join(rng.choice("abcdefgh ÜI") for _ in range(rng.randrange(60)))) for i in range(1200)]
    return spark.createDataFrame(rows, "id string, text string")


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    return ResultIndex.write(table, str(tmp_path_factory.mktemp("index") / "i"), "text", n_files=16)


def names(df):
    return df.inputFiles()


def test_pages_equal_offset_paging_and_read_few_files(table, index):
    want = [tuple(r) for r in table.orderBy(*X.sort_order("text", "asc")).collect()]
    assert index.total_pages() == 48
    for p in (1, 2, 17, 31, 48, 49):
        page = index.page(p)
        assert [(r.id, r.text) for r in page.orderBy("position").collect()] == want[25 * (p - 1):25 * p]
        assert len(names(page)) <= 2
    assert [r.position for r in index.page(48).orderBy("position").collect()][0] == 47 * 25 + 1


def test_cursors_walk_the_whole_table(table, index):
    want = [tuple(r) for r in table.orderBy(*X.sort_order("text", "asc")).collect()]
    got = index.page(1, 100).orderBy("position").collect()
    while len(got) < len(want):
        page = index.page_after(got[-1], 100, got[-1].position)
        assert len(names(page)) <= 4
        got += page.orderBy("position").collect()
    assert [(r.id, r.text) for r in got] == want and [r.position for r in got] == list(range(1, len(want) + 1))
    assert index.page_after(got[-1]).collect() == []


@pytest.mark.parametrize("query", ["abc", "ABCD", "ünï ab", "tie", "h g", "zzz", "ab", "", "ü", "a" * 50])
def test_search_equals_the_scan(table, index, query):
    assert sorted(index.search(query).collect()) == sorted(X.search(table, query=query).collect())


def test_search_reads_candidate_files_only(index):
    rare = index.search("ünï abababab")
    assert 0 < len(names(rare)) <= 3 and index.candidate_files("zzz") == [] and index.candidate_files("ab") is None


def test_an_empty_table(spark, tmp_path):
    empty = ResultIndex.write(spark.createDataFrame([], "id string, text string"), str(tmp_path / "e"), "text")
    assert empty.total_pages() == 1 and empty.page(1).collect() == [] and empty.search("abc").collect() == [] and empty.search("a").count() == 0


def test_long_texts_are_indexed_whole(spark, tmp_path):
    long = "x" * 200_000 + "needle"
    index = ResultIndex.write(spark.createDataFrame([("1", long), ("2", "y")], "id string, text string"), str(tmp_path / "l"), "id")
    assert [r.id for r in index.search("xNEEDLE").select("id").collect()] == ["1"]
    assert index.page(1).select(F.max("position")).first()[0] == 2
