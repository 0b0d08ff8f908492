"""Global order without a single-partition window.

Rows are split into order buckets of about equal row count (a pure function of
the order key, so it is stable across re-execution), running totals are taken
inside each bucket, and the bucket totals - one row per bucket, a bounded
number - supply the offsets.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialize

ROWS_PER_BUCKET = 256
MAX_BUCKETS = 1 << 16
SAMPLES_PER_BUCKET = 8


def bucket_bounds(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> list:
    """Upper-exclusive split points; the driver sees at most 8 sampled keys per bucket."""
    rows = df.select(key).count()
    wanted = max(2, -(-rows // rows_per_bucket))
    buckets = min(MAX_BUCKETS, 1 << (wanted - 1).bit_length())
    share = min(1.0, buckets * SAMPLES_PER_BUCKET / max(rows, 1))
    sample = sorted(r[0] for r in df.select(key).where(F.col(key).isNotNull()).sample(False, share, seed=11).collect())
    if not sample:
        return []
    return [sample[(i * len(sample)) // buckets] for i in range(1, buckets)]


def _points(bounds: list) -> Column:
    """The bounds as one literal: parsed from JSON where that says a value exactly, which is one call for all."""
    if isinstance(bounds[0], (int, str)) and not isinstance(bounds[0], bool):
        kind = "array<string>" if isinstance(bounds[0], str) else "array<bigint>"
        return F.from_json(F.lit(json.dumps(bounds)), kind)
    return F.lit(bounds)


def order_bucket(key: Column, bounds: list) -> Column:
    """Number of bounds that are <= key, by a branch-free binary search."""
    if not bounds:
        return F.when(key.isNull(), 1).otherwise(0)
    steps = []
    step = (len(bounds) + 1) // 2
    while step:
        steps.append(step)
        step //= 2
    points = _points(bounds)
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, s: F.when(F.element_at(points, at + s) <= key, at + s).otherwise(at),
    )


def running_totals(
    df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET, by: Sequence[str] = (), **values: Column
) -> DataFrame:
    """Add, per named value, the total over all rows (of the group) with a smaller ``key``.

    ``key`` must be unique (within ``by``).  Only the key and the values are
    dealt out, sorted and summed; the other columns meet the totals in one join.
    ``df`` is read several times, so pass a scan or a materialized table, not a
    long chain.
    """
    bounds = bucket_bounds(df, key, rows_per_bucket)
    group = [*by, "_bucket"]
    slim = df.select(*by, key, order_bucket(F.col(key), bounds).alias("_bucket"),
                     *[v.alias(f"_v_{n}") for n, v in values.items()])
    before = Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = slim.select(
        *group, key, *[F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_l_{n}") for n in values]
    )
    # One row per bucket (and group); without groups at most MAX_BUCKETS rows.
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slim.groupBy(*group).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
        .select(*group, *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values])
    )
    totals = local.join(offsets if by else F.broadcast(offsets), group).select(
        *by, key, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in values]
    )
    if set(df.columns) <= {key, *by}:
        return totals
    return df.join(totals, [*by, key]).select(*df.columns, *values)


def values_at(df: DataFrame, value: str, by: Sequence[str] = (), **picks: Callable[[Column], Column]) -> DataFrame:
    """Order statistics by 0-based index: each pick maps the row count to an index.

    Equal values are counted first, then placed by running totals per order
    bucket, so no group is ever sorted in one task.
    """
    counted = materialize(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), "values")
    placed = running_totals(counted, value, by=by, before=F.col("n"))
    totals = counted.groupBy(*by).agg(F.sum("n").alias("count"))
    if by:
        rows = placed.join(totals, list(by))
    else:
        rows = placed.select("*", totals.scalar().alias("count"))
    hit = {
        name: (F.col("before") <= pick(F.col("count"))) & (pick(F.col("count")) < F.col("before") + F.col("n"))
        for name, pick in picks.items()
    }
    return rows.groupBy(*by).agg(
        F.max("count").alias("count"), *[F.max(F.when(h, F.col(value))).alias(name) for name, h in hit.items()]
    )


def with_ordinal(df: DataFrame, key: str, name: str = "ordinal", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Dense 0-based position in ``key`` order."""
    return running_totals(df, key, rows_per_bucket, **{name: F.lit(1).cast("bigint")})


def take_until_budget(df: DataFrame, key: str, text: str, max_bytes: int, max_docs: int | None = None) -> DataFrame:
    """Documents in order until a UTF-8 byte budget; the crossing document stays.

    What fits is a prefix in key order, so the texts are filtered by its last
    key (which reaches the scan); only the prefix meets its totals.
    """
    sized = df.select(key, F.octet_length(text).cast("bigint").alias("n_bytes"))
    placed = running_totals(sized, key, bytes_before=F.col("n_bytes"), ordinal=F.lit(1).cast("bigint"))
    fits = F.col("bytes_before") < max_bytes
    if max_docs is not None:
        fits = fits & (F.col("ordinal") < max_docs)
    taken = materialize(placed.where(fits).select(key, "ordinal", "bytes_before"), "budget")
    last = taken.agg(F.max(key)).first()[0]
    if last is None:
        return df.join(taken, key)
    return df.where(F.col(key) <= last).join(taken, key)


def head_by_order(df: DataFrame, key: str, share: float, name: str = "held_out") -> DataFrame:
    """Flag the first int(n * share) rows in ``key`` order as held out."""
    n = df.agg(F.count("*")).scalar()
    return with_ordinal(df, key).select(
        "*", (F.col("ordinal") < F.floor(n * F.lit(share))).alias(name)
    )
