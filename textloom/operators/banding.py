"""Signatures that share a bucket, compared inside tasks.

A pair becomes a row only if it is wanted: no pair is joined, shuffled or made
distinct first.  Small buckets share a task; a large bucket is cut into blocks,
and two blocks meet in one task at a time, whatever the size of the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024        # members of a bucket that are compared with as many others at a time
CELL_ROWS = 4_000   # rows of small buckets that share a task
PAIRS = 1 << 14     # pairs compared at a time
LEADERS = 4096      # leaders of a bucket that meet a salt of it at a time


def _signatures(table: pa.Table) -> np.ndarray:
    rows = table.column("sig").combine_chunks()
    flat = rows.flatten().to_numpy().reshape(len(rows), -1)  # a table here has rows
    small = flat.size and 0 <= flat.min() and flat.max() < 1 << 32
    return np.ascontiguousarray(flat.astype(np.uint32) if small else flat)


def _runs(group: np.ndarray) -> np.ndarray:
    """First row of each run of equal values, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [group.size]])


def _within(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with i < j in the same run of rows, so many at a time."""
    sizes = np.diff(starts)
    rows = np.arange(starts[-1])
    after = np.repeat(starts[1:], sizes) - rows - 1
    ends = np.cumsum(after)
    for low in range(0, int(ends[-1]), PAIRS):
        place = np.arange(low, min(low + PAIRS, int(ends[-1])))
        i = np.searchsorted(ends, place, side="right")
        yield i, i + 1 + place - (ends[i] - after[i])


def _by_group(table: pa.Table, *columns: str) -> tuple[pa.Table, np.ndarray]:
    """The rows with those of one group next to each other, and where the groups start."""
    group = np.unique(np.stack([table.column(c).to_numpy() for c in columns]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(group, kind="stable")
    return table.take(pa.array(order)), _runs(group[order])


def _placed(members: DataFrame, key: str, sized: DataFrame) -> DataFrame:
    """Members with the two blocks that meet, and the cell where they do."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(key, "sig"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    # how many rows there are is known from the buckets alone
    cells = F.greatest(F.lit(1), F.floor(sized.agg(F.sum("size")).scalar() / CELL_ROWS)).cast("bigint")
    alone = (F.col("low") == 0) & (F.col("high") == 0)
    return met.withColumn("cell", F.when(alone, F.pmod(F.xxhash64("bucket"), cells)).otherwise(F.xxhash64("bucket", "low", "high")))


def pairs_in_buckets(members: DataFrame, sized: DataFrame, key: str, bands: int, least: float = 0.0, once: bool = False) -> DataFrame:
    """(i, j, similarity): members of a bucket with i < j that share a band and whose signatures agree in a share of ``least``.

    ``members`` is (bucket, size, band, key, sig), ``sized`` holds the sizes of
    its buckets.  A pair comes from each of its buckets, or with ``once`` from
    that of the first band it shares, which has to be among the buckets.
    """
    kind = members.schema[key].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        table, starts = _by_group(table, "bucket", "low", "high")
        sigs, ids = _signatures(table), table.column(key).to_numpy()
        band, block, low, high = (table.column(c).to_numpy() for c in ("band", "block", "low", "high"))
        found_i, found_j, found_s = [ids[:0]], [ids[:0]], [np.empty(0)]
        for i, j in _within(starts):
            apart = ((low[i] == high[i]) | (block[i] != block[j])) & (ids[i] != ids[j])
            i, j = i[apart], j[apart]
            same = sigs[i] == sigs[j]
            share = same.sum(axis=1) / sigs.shape[1]
            near = share >= least
            i, j, same, share = i[near], j[near], same[near], share[near]
            banded = same.reshape(i.size, bands, sigs.shape[1] // bands).all(axis=2)
            held = banded[np.arange(i.size), band[i]] & (banded.argmax(axis=1) == band[i]) if once else banded.any(axis=1)
            x, y = ids[i[held]], ids[j[held]]
            found_i.append(np.minimum(x, y))
            found_j.append(np.maximum(x, y))
            found_s.append(share[held])
        return pa.table({"i": np.concatenate(found_i), "j": np.concatenate(found_j), "similarity": np.concatenate(found_s)})

    met = _placed(members.where(F.col(key).isNotNull()), key, sized).select("cell", "bucket", "low", "high", "block", "band", key, "sig")
    return met.groupBy("cell").applyInArrow(compare, f"i {kind}, j {kind}, similarity double")


def followers(leaders: DataFrame, rest: DataFrame, salts: Column, count: Column, key: str, bands: int, least: float) -> DataFrame:
    """(key): rows of ``rest`` that follow a leader of their bucket, share a band with it and agree in a share of ``least``.

    Both are (bucket, size, key, sig); ``salts`` deals the rest of a bucket of
    that size, ``count`` (of leaders) its leaders, and each part of the one
    meets each part of the other in a task.
    """
    kind = rest.schema[key].dataType.simpleString()
    parts = F.ceil(count / LEADERS).cast("int")
    lead = leaders.select("bucket", key, "sig", F.pmod(F.xxhash64(key), parts).cast("int").alias("part"),
                          F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("side"))
    own = rest.select("bucket", key, "sig", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
                      F.pmod(F.xxhash64(key), salts).cast("int").alias("salt"), F.lit(1).alias("side"))

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ahead, after = (table.filter(pa.array(side == n)) for n in (0, 1))
        left, ids = np.ones(after.num_rows, dtype=bool), after.column(key).to_numpy()
        if ahead.num_rows and after.num_rows:
            heads, order = ahead.column(key).to_numpy(), np.arange(after.num_rows)
            both = _signatures(pa.concat_tables([ahead.select(["sig"]), after.select(["sig"])]))
            sigs = both[ahead.num_rows :]
            for head, sig in zip(heads, both):
                same = sigs == sig
                near = np.flatnonzero((same.sum(axis=1) / sigs.shape[1] >= least) & (ids[order] > head))
                near = near[same[near].reshape(near.size, bands, sigs.shape[1] // bands).all(axis=2).any(axis=1)]
                if near.size:
                    left[order[near]] = False
                    sigs, order = np.delete(sigs, near, axis=0), np.delete(order, near)
        return pa.table({key: ids[~left]})

    return lead.unionByName(own).groupBy("bucket", "part", "salt").applyInArrow(compare, f"{key} {kind}")
