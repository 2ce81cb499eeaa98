"""Every landscape query against its SQL in DuckDB."""

import glob
import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__  # noqa: F401  registers all queries
from cairnframe.plans.registry import ORACLE, QUERIES

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _plain(value):
    return round(value, 7) + 0.0 if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = sorted(repr([_plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name not in ORACLE:
        assert rows
        return
    want = duck.sql(ORACLE[name])
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(want.columns) == sorted(df.columns)
    assert rows == sorted(repr([_plain(r[i]) for i in order]) for r in want.fetchall())


def test_means_do_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    rnd = random.Random(2)
    path = tmp_path / "lineitem.parquet"
    path.mkdir()
    for k in range(3):
        rows = [(rnd.randrange(2000), rnd.randrange(50), rnd.choice([None, *(x / 100 for x in range(11))])) for _ in range(3000)]
        pq.write_table(pa.table(dict(zip(("l_orderkey", "l_suppkey", "l_discount"), map(list, zip(*rows, strict=True)), strict=True))), path / f"{k}.parquet")
    con = duckdb.connect()
    con.sql("set threads = 1")
    con.sql(f"create view lineitem as select * from '{path}/*.parquet'")
    want = sorted(con.sql(ORACLE["threshold_by_mean"]).fetchall())
    assert sorted(map(tuple, QUERIES["threshold_by_mean"](spark, str(tmp_path)).collect())) == want
