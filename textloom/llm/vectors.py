"""Sparse TF-IDF vectors over a fixed number of hashed terms, shared by the classifiers.

A term function maps a text to (term numbers, counts).  Document frequencies
are counted over all rows: every task sums its own and sends one row per term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices

Terms = Callable[[str], tuple[np.ndarray, np.ndarray]]


def hashed(values: np.ndarray, dims: int) -> np.ndarray:
    """Term numbers below ``dims`` (a power of two) of 64-bit keys."""
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (dims.bit_length() - 1))


def counted(numbers: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    if numbers.size > dims // 4:
        counts = np.bincount(numbers.astype(np.int64), minlength=dims)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(numbers.astype(np.int64), return_counts=True)


def document_frequencies(docs: DataFrame, terms: Terms, dims: int) -> tuple[int, np.ndarray]:
    """Rows, and rows that have each term, over all of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(dims + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    seen[terms(text)[0]] += 1
                seen[dims] += part.num_rows
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], names=["term", "n"])

    rows = docs.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(dims + 1, dtype=np.int64)
    out[rows["term"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return int(out[dims]), out[:dims]


def inverse(rows: int, frequencies: np.ndarray) -> np.ndarray:
    """Smoothed inverse document frequencies; a term of every row weighs nearly nothing."""
    return np.log((rows + 1.0) / (frequencies + 0.5)).clip(0).astype(np.float32)


def weigh(numbers: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length weights (1 + ln count) * idf of a text's terms; zeros where nothing has weight."""
    values = (1 + np.log(counts)).astype(np.float32) * idf[numbers]
    norm = float(np.sqrt(values @ values))
    return values / norm if norm > 0 else np.zeros_like(values)


def dense(texts: list[str], terms: Terms, idf: np.ndarray, dims: int) -> np.ndarray:
    out = np.zeros((len(texts), dims), dtype=np.float32)
    for row, text in zip(out, texts):
        numbers, counts = terms(text)
        row[numbers] = weigh(numbers, counts, idf)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
