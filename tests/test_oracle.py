"""Every catalogue query at sf0.001 against its DuckDB SQL (order-insensitive, 6 dp)."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from textpool.plans import catalog
from tests.conftest import SF_SMALL
from textpool.sources.tables import TABLES, table_path

QUERIES = catalog.QUERIES  # the training-data queries have tests of their own
SQL = catalog.ORACLE


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return c


def test_every_query_has_oracle_or_is_declared_rows_only():
    rows_only = set(QUERIES) - set(SQL)
    assert rows_only <= {"tfidf_logreg"}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert hashlib.sha1("\n".join(_digest(df.columns, srows)).encode()).hexdigest() == \
        hashlib.sha1("\n".join(_digest(dcols, drows)).encode()).hexdigest()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["Polarity", "count"] and df.count() >= 0
