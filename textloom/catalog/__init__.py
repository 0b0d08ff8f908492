"""Named queries over the test tables, each next to its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{table}.parquet")


def load_all() -> None:
    from textloom.catalog import (  # noqa: F401
        cleaning, deduplication, drifting, evaluation, governing, serving, sourcing, statistics, tokenizing, training,
    )
