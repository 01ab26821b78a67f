"""Corpus queries against their oracle SQL, and all of them over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_
from cuesheet.llm import contracts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(contracts.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = contracts.queries()[name](spark, SF)
    want = con.sql(contracts.oracle_sql()[name])
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_all_are_registered():
    names = entry_.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in contracts.queries()} == {f"op{k}" for k in range(1, 14)} <= {n.split("_")[0] for n in names}
