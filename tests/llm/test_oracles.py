"""The operators that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from cairnframe.llm.queries import ORACLE, QUERIES

from ..conftest import DATA


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, DATA).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
