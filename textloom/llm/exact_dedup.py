"""Exact deduplication by two passes of a Bloom filter.

Pass one folds the content hash of every row into a filter whose cells
saturate at "hit twice".  A row whose cells are all hit twice is possibly
repeated; only such rows shuffle, and every other row passes straight through
to the result.  The filter is cut into blocks of ``2**20`` cells (a row's cells
share one block), so that blocks are merged on the executors, in parallel and
each from a bounded number of entries.  Probing broadcasts at most
``SLICE_BLOCKS`` blocks at a time (64 MB); a larger filter takes several such
passes over the 40-byte hash rows, never over the texts.

Rows that the filter takes for repeated by mistake (about 3 in 1,000) are
grouped like the others and found to be single, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import per_batch, stored, texts

CELL_BITS = 20
CELLS_PER_ROW = 16
PROBES = 4
SLICE_BLOCKS = 512
SCHEMA = "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"


def _words(digests: pa.Array) -> np.ndarray:
    """The hashes as rows of four 64-bit words."""
    return np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 4)


def _place(words: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each row and its cells there."""
    block = (words[:, 0] % np.uint64(blocks)).astype(np.int64)
    cells = np.stack([words[:, 1 + i // 2] >> np.uint64(32 * (i % 2)) for i in range(PROBES)], axis=1)
    return block, (cells & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)


def _distinct_cells(cells: np.ndarray) -> np.ndarray:
    """Mark cells that an earlier probe of the same row has hit already."""
    again = np.zeros(cells.shape, dtype=bool)
    for i in range(1, PROBES):
        again[:, i] = (cells[:, :i] == cells[:, i : i + 1]).any(axis=1)
    return ~again


def hash_rows(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))


def build_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, twice): a bitmap of the cells that at least two rows hit."""

    def fold(batch: pa.RecordBatch) -> dict | None:
        if not batch.num_rows:
            return None
        block, cells = _place(_words(batch.column("digest")), blocks)
        keep = _distinct_cells(cells)
        at = ((block[:, None] << CELL_BITS) | cells)[keep]
        at, counts = np.unique(at, return_counts=True)
        at = np.repeat(at, np.minimum(counts, 2))
        own = at >> CELL_BITS
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ends = np.r_[starts[1:], at.size]
        low = (at & ((1 << CELL_BITS) - 1)).astype("<u4")
        return {"block": own[starts], "cells": [low[a:b].tobytes() for a, b in zip(starts, ends)]}

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << CELL_BITS, dtype=np.uint8)
        for raw in frame["cells"]:
            cells, hits = np.unique(np.frombuffer(raw, dtype="<u4"), return_counts=True)
            counts[cells] = np.minimum(counts[cells] + hits, 2)
        return pd.DataFrame({"block": [key[0]], "twice": [np.packbits(counts > 1, bitorder="little").tobytes()]})

    parts = per_batch(hashes, fold, "block bigint, cells binary")
    return parts.groupBy("block").applyInPandas(merge, "block bigint, twice binary")


def possibly_repeated(hashes: DataFrame, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """The hash rows with ``maybe``: false means that no other row has this hash."""
    spark = hashes.sparkSession
    rows = hashes.count()
    blocks = max(1, -(-rows * CELLS_PER_ROW >> CELL_BITS))
    filter_blocks = stored(build_filter(hashes, blocks), "bloom")
    out = None
    for first in range(0, blocks, slice_blocks):
        last = min(first + slice_blocks, blocks)
        slice_rows = filter_blocks.where(F.col("block").between(first, last - 1)).collect()
        bits = np.zeros((last - first, 1 << (CELL_BITS - 3)), dtype=np.uint8)
        for r in slice_rows:
            bits[r["block"] - first] = np.frombuffer(r["twice"], dtype=np.uint8)
        shared = spark.sparkContext.broadcast(bits)

        def probe(batch: pa.RecordBatch, first=first, last=last, shared=shared) -> dict | None:
            if not batch.num_rows:
                return None
            block, cells = _place(_words(batch.column("digest")), blocks)
            own = (block >= first) & (block < last)
            block, cells = block[own] - first, cells[own]
            hit = shared.value[block[:, None], cells >> 3] >> (cells & 7).astype(np.uint8) & 1
            picked = batch.filter(pa.array(own)) if not own.all() else batch
            return {"doc_id": picked.column("doc_id"), "digest": picked.column("digest"), "maybe": hit.all(axis=1)}

        part = per_batch(hashes, probe, "doc_id bigint, digest binary, maybe boolean")
        out = part if out is None else out.unionByName(part)
    return out


def exact_dedup(docs: DataFrame, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """One row per input row: which row of its group of equal texts stays.

    Of equal texts the row with the largest doc_id stays.  Null text counts as
    empty, so null and empty texts are one group.  A null doc_id counts as
    smallest.  Where one row is there several times, one of them has ``kept``.
    An empty table gives an empty result; further columns are ignored.
    """
    hashes = stored(hash_rows(docs), "hashes")
    flagged = possibly_repeated(hashes, slice_blocks)
    passed = flagged.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    suspects = flagged.where("maybe").groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    suspects = stored(suspects, "suspects")
    # written, so that the join below has an exchange of its own on either side and large groups can be split
    groups = stored(suspects.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size")), "groups")
    settled = (
        suspects.join(groups, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
    return passed.unionByName(settled)
