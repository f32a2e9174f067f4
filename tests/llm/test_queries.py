"""Queries of the subpackage against their SQL on the smallest tables, and all of them on tables without rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from jikjo.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    want = con.sql(queries.SQL[name])
    assert sorted(want.columns) == cols
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert got == sorted(map(str, want.select(*[f'"{c}"' for c in cols]).fetchall()))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    from tests.conftest import DATA

    to = tmp_path_factory.mktemp("empty")
    for f in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(f).limit(0).write.parquet(f"{to}/{os.path.basename(f)}")
    return str(to)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0
