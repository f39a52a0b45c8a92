"""Queries with SQL give the same rows in Spark and DuckDB."""

import math
import os

import pytest

from weblathe.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01" if os.environ.get("ORACLE_FULL") else "/root/testdata/sf0.001"


def plain(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in cursor.description)
    want = cursor.df()[columns].astype(object)
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == columns
    rows = lambda df: sorted((tuple(None if v != v else plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)
