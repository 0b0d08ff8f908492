"""Every named query against its SQL check, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from textloom import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
NAMES = sorted(set(QUERIES) & set(catalog.QUERIES))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF)
    columns = sorted(result.columns)
    rows = sorted(tuple(normal(r[c]) for c in columns) for r in result.collect())
    assert rows
    if name in ORACLES:
        answer = duck.execute(ORACLES[name])
        names = [d[0] for d in answer.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted(tuple(normal(r[i]) for i in at) for r in answer.fetchall())


def test_entry(spark):
    rows = {r["stage"]: r for r in contract.entry(spark).collect()}
    assert list(rows) == ["quality", "exact_dedup", "near_dedup"] and rows["quality"]["n_in"] == 200
