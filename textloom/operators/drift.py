"""Distribution drift of live text or numbers against a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.characters import character_summary
from textloom.operators.stream import placed_units, units

# Fixed values of the drift report.
TOP_BUCKETS = 50
EPSILON = 1e-6
SLIGHT, SEVERE = 0.1, 0.25
SMOOTHING = 0.5
OTHER = ""  # bucket of everything outside the top list; no character is empty


def baseline_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int | None = None) -> DataFrame:
    """Character counts of the stream, with the place (key, position) where each is first seen.

    ``sample`` takes the first so many stream characters only; by default all count.
    """
    if sample is None:
        pieces = units(docs, key, text).withColumnRenamed("unit", "piece")
    else:
        placed = placed_units(docs, key, text).where(F.col("start") < sample)
        left = (F.lit(sample) - F.col("start")).cast("int")
        whole = F.col("start") + F.col("n") <= sample
        pieces = placed.select(key, F.when(whole, F.col("unit")).otherwise(F.left("unit", left)).alias("piece"))
    return character_summary(pieces, key, "piece")


def baseline_buckets(counts: DataFrame, top: int = TOP_BUCKETS) -> DataFrame:
    """Share of the ``top`` most frequent characters plus one bucket for the rest."""
    total = counts.agg(F.sum("n")).scalar()
    best = counts.orderBy(F.col("n").desc(), "first_at").limit(top).select("ch", (F.col("n") / total).alias("share"))
    rest = best.agg(F.greatest(F.lit(EPSILON), 1 - F.sum("share")).alias("share")).select(F.lit(OTHER).alias("ch"), "share")
    return best.unionByName(rest)


def oov_rate(live: DataFrame, vocab: DataFrame, token: str = "ch") -> DataFrame:
    """Share of live characters the baseline never saw."""
    total = live.agg(F.sum("n")).scalar()
    unknown = live.join(vocab.select(token), token, "left_anti").agg(F.sum("n")).scalar()
    rate = F.coalesce(F.try_divide(F.coalesce(unknown, F.lit(0)), total), F.lit(0.0))
    return live.sparkSession.range(1).select(F.coalesce(total, F.lit(0)).alias("chars_seen"), rate.alias("oov_rate"))


def character_psi(buckets: DataFrame, live: DataFrame) -> DataFrame:
    """Population stability index over the buckets; no traffic gives 0."""
    total = live.agg(F.sum("n")).scalar()
    named = buckets.where(F.col("ch") != OTHER).join(live, "ch", "left").select("ch", "share", F.coalesce("n", F.lit(0)).alias("n"))
    covered = named.agg(F.sum("n")).scalar()
    other = buckets.where(F.col("ch") == OTHER).select("ch", "share", (total - covered).alias("n"))
    floor = lambda c: F.greatest(c, F.lit(EPSILON))
    b = F.when(F.col("ch") == OTHER, F.col("share")).otherwise(floor(F.col("share")))
    o = floor(F.col("n") / total)
    shift = F.when(total > 0, (o - b) * F.log(o / b))  # NULL without traffic
    return named.unionByName(other).agg(F.coalesce(F.sum(shift), F.lit(0.0)).alias("psi"))


def drift_level(psi: Column) -> Column:
    return F.when(psi < SLIGHT, F.lit("stable")).when(psi < SEVERE, F.lit("slight")).otherwise(F.lit("severe"))


def drift_report(requests: Column, buckets: DataFrame, vocab: DataFrame, live: DataFrame) -> DataFrame:
    """Requests, characters, OOV rate, PSI, level and retrain flag in one row."""
    psi = character_psi(buckets, live).scalar()
    row = oov_rate(live, vocab).select(requests.alias("requests"), "chars_seen", "oov_rate", psi.alias("psi"))
    return row.select(
        "requests", "chars_seen", F.round("oov_rate", 4).alias("oov_rate"), F.round("psi", 4).alias("psi"),
        drift_level(F.col("psi")).alias("level"), (F.col("psi") >= SEVERE).alias("retrain_suggested"),
    )


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Half-open bin number, NULL outside all bins."""
    ladder = F.when((value >= edges[0]) & (value < edges[1]), F.lit(0))
    for i in range(1, len(edges) - 1):
        ladder = ladder.when((value >= edges[i]) & (value < edges[i + 1]), F.lit(i))
    return ladder


def smoothed_histogram(rows: DataFrame, value: str, edges: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Share per bin with +0.5 per bin; values outside the bins are ignored."""
    bins = len(edges) - 1
    counts = rows.select(*by, bin_of(F.col(value), edges).alias("bin")).where(F.col("bin").isNotNull())
    per_bin = [F.struct(F.lit(i).alias("bin"), F.count_if(F.col("bin") == i).alias("n")) for i in range(bins)]
    wide = counts.groupBy(*by).agg(F.count("*").alias("total"), F.array(*per_bin).alias("bins"))
    return wide.select(*by, "total", F.inline("bins")).select(
        *by, "bin", ((F.col("n") + SMOOTHING) / (F.col("total") + SMOOTHING * bins)).alias("p")
    )


def numeric_psi(rows: DataFrame, value: str, edges: Sequence[float], side: str, reference: str, live: str) -> DataFrame:
    """Index between two values of ``side`` on fixed bins."""
    hist = smoothed_histogram(rows.where(F.col(side).isin(reference, live)), value, edges, [side])
    wide = hist.groupBy("bin").agg(
        F.max(F.when(F.col(side) == reference, F.col("p"))).alias("p_ref"), F.max(F.when(F.col(side) == live, F.col("p"))).alias("p_new")
    )
    psi = wide.agg(F.sum((F.col("p_new") - F.col("p_ref")) * F.log(F.col("p_new") / F.col("p_ref"))).alias("psi"))
    return psi.select("psi", drift_level(F.col("psi")).alias("level"))
