"""Every query with SQL gives the same rows in Spark and DuckDB."""

import math
import os

import pytest

import __spark_entry__
from weblathe.plans import captures, corpus, documents, folds, functions, hot, oracle, sites, streams, trees

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01" if os.environ.get("ORACLE_FULL") else "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return str(value) if value is not None and not isinstance(value, (bool, int, str)) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.SQL | captures.SQL | documents.SQL | folds.SQL | functions.SQL | hot.SQL | sites.SQL | streams.SQL | trees.SQL))
def test_query_equals_oracle(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cursor = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = rows(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, df.collect())
    assert got == want
    assert want


def test_names_agree():
    assert set(oracle.SQL) <= set(corpus.QUERIES) and set(captures.SQL) <= set(captures.QUERIES)
    assert set(corpus.QUERIES) <= set(__spark_entry__.queries())
