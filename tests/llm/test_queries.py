"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from textloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = QUERIES[name](spark, SF)
    columns = sorted(result.columns)
    rows = sorted(tuple(str(r[c]) for c in columns) for r in result.collect())
    if name != "op9_repeated_passages":
        assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for table in os.listdir(SF):
            con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
        answer = con.execute(ORACLES[name])
        names = [d[0] for d in answer.description]
        at = [names.index(c) for c in columns]
        assert rows == sorted(tuple(str(r[i]) for i in at) for r in answer.fetchall())


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 100 < len(rows) < 200 and all(r["same"] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
