"""Serving telemetry; every function takes a batch or a streaming request table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.drift import SEVERE
from textloom.operators.ordinals import values_at

# Histogram borders of the serving metrics and the rate window.
LATENCY_BORDERS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
BATCH_BORDERS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
AGREEMENT_BORDERS = (0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0)
RATE_WINDOW = "1 minute"


def minute(ts: str = "ts", width: str = RATE_WINDOW) -> Column:
    return F.window(ts, width)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("window.start")).drop("window")


def request_totals(requests: DataFrame, by: Sequence[str] = ("endpoint", "status")) -> DataFrame:
    return requests.groupBy(*by).agg(F.count("*").alias("requests"))


def request_rate(requests: DataFrame, by: Sequence[str] = ("endpoint",), width: str = RATE_WINDOW, seconds: int = 60) -> DataFrame:
    """Requests per second in each window."""
    return _flat(requests.groupBy(minute(width=width), *by).agg(F.count("*").alias("requests"))).withColumn(
        "rate", F.col("requests") / seconds
    )


def latency_percentiles(requests: DataFrame, by: Sequence[str] = (), value: str = "latency") -> DataFrame:
    """Exact p50 and p95 by the index rule min(n - 1, int(p * n))."""
    at = lambda p: lambda n: F.least(n - 1, F.floor(F.lit(p) / 100 * n))
    return values_at(requests, value, by=by, p50=at(50), p95=at(95))


def latency_sketch(requests: DataFrame, by: Sequence[str], ps: Sequence[float] = (0.5, 0.95), value: str = "latency", accuracy: int = 10000) -> DataFrame:
    """Mergeable approximation for streams and very large groups."""
    return requests.groupBy(*by).agg(*[F.percentile_approx(value, p, accuracy).alias(f"p{round(p * 100)}") for p in ps])


def _histogram(value: str, borders: Sequence[float]) -> Column:
    v = F.col(value)
    counts = [F.struct(F.lit(float(b)).alias("le"), F.count_if(v <= b).alias("cumulative_count")) for b in borders]
    counts.append(F.struct(F.lit(float("inf")).alias("le"), F.count(v).alias("cumulative_count")))
    return F.array(*counts).alias("h")


def bucket_counts(rows: DataFrame, value: str, borders: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative histogram (le, cumulative_count); the last border is infinity."""
    return rows.groupBy(*by).agg(_histogram(value, borders)).select(*by, F.inline("h"))


def windowed_histogram(rows: DataFrame, by: Sequence[str] = ("variant",), value: str = "latency", borders: Sequence[float] = LATENCY_BORDERS,
                       width: str = RATE_WINDOW) -> DataFrame:
    """One row per window and group with its cumulative histogram ``h``; also for streams, where it is the whole state."""
    return _flat(rows.groupBy(minute(width=width), *by).agg(_histogram(value, borders)))


def windowed_quantile(histograms: DataFrame, q: float, by: Sequence[str] = ("variant",)) -> DataFrame:
    """Interpolated quantile of each window and group of ``windowed_histogram``."""
    keys = ["window_start", *by]
    return histogram_quantile(histograms.select(*keys, F.inline("h")), q, keys)


def histogram_quantile(histogram: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation inside the bucket that holds rank q * total.

    The infinite bucket yields the largest finite border; the first bucket
    starts at zero.  Windows are as long as the border list.
    """
    order = Window.partitionBy(*by).orderBy("le")
    whole = Window.partitionBy(*by)
    placed = histogram.select(
        *by, "le", "cumulative_count",
        F.coalesce(F.lag("le").over(order), F.lit(0.0)).alias("lower"),
        F.coalesce(F.lag("cumulative_count").over(order), F.lit(0)).alias("below"),
        (F.max("cumulative_count").over(whole) * q).alias("target"),
    )
    inside = F.try_divide(F.col("target") - F.col("below"), F.col("cumulative_count") - F.col("below"))
    value = F.when(F.col("le") == float("inf"), F.col("lower")).otherwise(
        F.col("lower") + (F.col("le") - F.col("lower")) * inside
    )
    hit = placed.where((F.col("cumulative_count") >= F.col("target")) & (F.col("target") > 0))
    return hit.groupBy(*by).agg(F.min_by(value, "le").alias("quantile"))


def token_throughput(requests: DataFrame, width: str = RATE_WINDOW, seconds: int = 60) -> DataFrame:
    return _flat(requests.groupBy(minute(width=width)).agg(F.sum("tokens").alias("tokens"))).withColumn(
        "tokens_per_second", F.col("tokens") / seconds
    )


def running_tokens(throughput: DataFrame) -> DataFrame:
    """Total generated tokens up to each window (batch only)."""
    from textloom.operators.ordinals import running_totals

    before = running_totals(throughput, "window_start", before=F.col("tokens"))
    return before.withColumn("total_tokens", F.col("before") + F.col("tokens")).drop("before")


def variant_traffic(requests: DataFrame, width: str = RATE_WINDOW) -> DataFrame:
    return _flat(requests.groupBy(minute(width=width), "variant").agg(F.count("*").alias("requests")))


def average_batch(requests: DataFrame, by: Sequence[Column] = (), size: str = "batch_size") -> DataFrame:
    return requests.groupBy(*by).agg(
        F.sum(size).alias("size_sum"), F.count(size).alias("batches"), (F.sum(size) / F.count(size)).alias("avg_batch")
    )


def shadow_agreement(predictions: DataFrame, live: str = "production", shadow: str = "candidate", request: str = "request_id") -> DataFrame:
    """Share of equal predictions per request; one aggregate instead of a self-join."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("pred")))
    at = predictions.groupBy(request, "pos").agg(pick(live).alias("a"), pick(shadow).alias("b"))
    return at.where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy(request).agg(
        F.count("*").alias("positions"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement")
    )


def agreement_by_window(agreements: DataFrame, requests: DataFrame, request: str = "request_id", key: str = "event_id", width: str = RATE_WINDOW) -> DataFrame:
    """Mean agreement of the shadowed requests of each window."""
    timed = agreements.join(requests.select(F.col(key).alias(request), "ts"), request)
    return _flat(timed.groupBy(minute(width=width)).agg(F.count("*").alias("compared"), F.avg("agreement").alias("agreement")))


def cold_start(requests: DataFrame, ts: str = "ts", key: str = "event_id", by: Sequence[str] = (), value: str = "latency") -> DataFrame:
    """First request against p50 and p95 of the rest, and the cold/warm ratio."""
    first = requests.groupBy(*by).agg(F.min(F.struct(ts, key)).alias("first"), F.min_by(value, F.struct(ts, key)).alias("cold"))
    starts = first.select(F.col(f"first.{key}").alias(key))
    warm = latency_percentiles(requests.join(starts, key, "left_anti"), by, value)
    if by:
        joined = first.join(warm, list(by))
    else:
        joined = first.select("cold", *[warm.select(c).scalar().alias(c) for c in ("count", "p50", "p95")])
    return joined.select(*by, "cold", "p50", "p95", F.try_divide("cold", "p50").alias("ratio"))


def route_percent(request_id: Column, salt: str = "") -> Column:
    """Reproducible bucket 0..99 of a request."""
    digest = F.sha1(F.concat(F.lit(salt), request_id.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(100))


def canary_routing(requests: DataFrame, canary_pct: int, shadow_pct: int, key: str = "event_id") -> DataFrame:
    return requests.withColumn(
        "variant", F.when(route_percent(F.col(key)) < canary_pct, F.lit("canary")).otherwise(F.lit("production"))
    ).withColumn("shadowed", route_percent(F.col(key), "shadow:") < shadow_pct)


def rollout_decision(candidates: DataFrame) -> DataFrame:
    """The quality gate decides; agreement, latency and input drift only advise.

    Expects: reasons (array), agreement, canary_p95, production_p95, psi.
    """
    advice = F.array_compact(
        F.array(
            F.when(F.col("agreement") < 0.9, F.lit("behaviour changed, review outputs")),
            F.when(F.col("canary_p95") > F.col("production_p95"), F.lit("canary slower")),
            F.when(F.col("psi") >= SEVERE, F.lit("input drift")),
        )
    )
    return candidates.withColumn(
        "decision", F.when(F.size("reasons") == 0, F.lit("release")).otherwise(F.lit("hold"))
    ).withColumn("advice", advice)
