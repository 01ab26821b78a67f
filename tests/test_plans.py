"""Every planning query against its oracle SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_
from cuesheet.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    as_rows = lambda x: sorted(map(tuple, x[cols].astype(str).values.tolist()))
    assert as_rows(got) == as_rows(want)


def test_entry(spark):
    assert entry_.entry(spark).count() > 0
    assert set(entry_.oracle_sql()) <= set(entry_.queries())
