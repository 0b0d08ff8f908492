"""Sinks.  All of them write from the executors; nothing is gathered first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.tokens import token_dtype


def write_pairs(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_run_log(log: DataFrame, path: str) -> None:
    """One folder of CSV files per run; each task sorts and writes what it has."""
    log.sortWithinPartitions("run", "step").write.mode("overwrite").partitionBy("run").option("header", "true").csv(path)


def write_token_blocks(blocks: DataFrame, path: str, vocab_size: int) -> None:
    """Token blocks partitioned by split; the id width follows the vocabulary."""
    width = token_dtype(F.lit(vocab_size)).alias("token_dtype")
    blocks.select("*", width).write.mode("overwrite").partitionBy("split").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_merged_text(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Clean documents in order with a blank line between, as part files whose concatenation is the text.

    The last document ends with one line end and no blank line.
    """
    last = docs.agg(F.max(key)).scalar()
    spaced = F.when(F.col(key) == last, F.col(text)).otherwise(F.concat(F.col(text), F.lit("\n")))
    ordered = docs.select(key, spaced.alias("value")).repartitionByRange(key).sortWithinPartitions(key)
    ordered.select("value").write.mode("overwrite").text(path)


def write_cards(cards: DataFrame, path: str) -> None:
    cards.write.mode("overwrite").partitionBy("short").text(path)
