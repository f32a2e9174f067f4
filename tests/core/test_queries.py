"""Every query against its SQL on the smallest tables, as the driver does on larger ones."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from jikjo.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, (bool, int, np.integer)):
        return int(v)
    return repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def data():
    from tests.conftest import DATA

    return str(DATA)


#: Queries without SQL, and the test that holds each against plain Python or its own parts.
CHECKED_ELSEWHERE = {
    "f14_pronoun_context": "test_pronouns_with_the_nouns_around",
    "n2_routed_chunks": "test_routed_chunks_by_source",
    "n3_domain_texts": "test_domain_texts",
    "n5_training_set": "test_training_set_is_of_all_sources",
    "n5_quality": "test_quality_of_the_training_set",
    "n7_filtered": "test_filtered_texts_of_each_source",
    "n8_two_targets": "test_two_targets_by_triple_gate",
}


def test_queries_without_sql_are_tested():
    from pathlib import Path

    tests = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    assert {n for n in catalog.QUERIES if n not in catalog.SQL} == set(CHECKED_ELSEWHERE)
    assert all(f"def {t}(" in tests for t in CHECKED_ELSEWHERE.values())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, data, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in catalog.SQL:
        rel = con.sql(catalog.SQL[name])
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    else:
        assert name in CHECKED_ELSEWHERE and (rows or name == "n7_filtered")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.schema == entry.entry(spark).schema
