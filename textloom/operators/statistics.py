"""Corpus statistics and health bands."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.vectorized import gzip_size_column
from textloom.operators.characters import character_summary, character_totals
from textloom.operators.ordinals import values_at
from textloom.operators.stream import placed_units, units

# Healthy ranges of the four standing rules.
HEALTH_RULES = (
    ("total_chars", 1_000_000.0, 1e12, "small models want a million characters or more"),
    ("entropy_efficiency", 0.55, 0.97, "how varied the characters are, comparable across languages"),
    ("compression_ratio", 0.30, 0.70, "smaller means more repetitive"),
    ("dup_rate", 0.0, 0.30, "share of documents removed as copies"),
)


def char_counts(texts: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    if not by:
        return character_totals(texts, text)
    chars = texts.select(*by, F.explode(F.split(F.col(text), "")).alias("ch")).where(F.col("ch") != "")
    return chars.groupBy(*by, "ch").agg(F.count("*").alias("n"))


def stream_char_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Character counts of the merged corpus, separators included."""
    return char_counts(units(docs, key, text), "unit")


def entropy_of(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Shannon entropy in bits: log2(N) - sum(n*log2(n))/N."""
    total = F.sum("n")
    bits = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    return counts.groupBy(*by).agg(
        F.count("*").alias("vocab_size"), F.coalesce(total, F.lit(0)).alias("total_chars"),
        F.coalesce(F.greatest(bits, F.lit(0.0)), F.lit(0.0)).alias("entropy"),
    )


def entropy_efficiency(entropy: Column, vocab_size: Column) -> Column:
    return F.when(vocab_size > 1, F.round(entropy / F.log2(vocab_size), 3)).otherwise(F.lit(0.0))


def document_compression(docs: DataFrame, text: str = "text", level: int = 6, name: str = "compression_ratio") -> DataFrame:
    raw = F.octet_length(text)
    packed = gzip_size_column(level)(F.col(text))
    return docs.withColumn(name, F.when(raw == 0, F.lit(0.0)).otherwise(packed / raw))


def corpus_compression(docs: DataFrame, key: str = "doc_id", text: str = "text", level: int = 6, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Corpus ratio from gzip members of about ``chunk_bytes`` of ordered text.

    One gzip stream over everything would be a single task; members restart
    the 32 KB window once per chunk, which moves the ratio by a fraction of a
    percent.
    """
    import gzip

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                raw = value.encode("utf-8")
                yield pa.RecordBatch.from_pydict(
                    {"raw": pa.array([len(raw)], pa.int64()),
                     "packed": pa.array([len(gzip.compress(raw, compresslevel=level))], pa.int64())}
                )

    placed = placed_units(docs, key, text)
    chunk = F.floor(F.col("start") / chunk_bytes)
    ordered = F.array_sort(F.collect_list(F.struct("start", "unit")))
    chunks = placed.groupBy(chunk.alias("chunk")).agg(F.array_join(F.transform(ordered, lambda u: u["unit"]), "").alias("body"))
    sizes = chunks.select("body").mapInArrow(squeeze, "raw bigint, packed bigint")
    return sizes.agg(
        F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum("packed"), F.lit(0)).alias("packed_bytes"),
        F.coalesce(F.try_divide(F.sum("packed"), F.sum("raw")), F.lit(0.0)).alias("compression_ratio"),
    )


def top_characters(docs: DataFrame, key: str = "doc_id", text: str = "text", top: int = 20) -> DataFrame:
    """Most frequent characters of the stream; ties go to the first one seen."""
    seen = character_summary(units(docs, key, text), key, "unit")
    return seen.orderBy(F.col("n").desc(), "first_at").limit(top).select("ch", "n")


def length_summary(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, min, max, mean (one decimal) and upper median of the lengths."""
    lengths = docs.select(*by, F.length(text).cast("bigint").alias("length"))
    middle = values_at(lengths, "length", by=by, median=lambda n: F.floor(n / 2))
    basic = lengths.groupBy(*by).agg(
        F.min("length").alias("min"), F.max("length").alias("max"), F.round(F.avg("length"), 1).alias("mean")
    )
    if by:
        return basic.join(middle, list(by))
    picked = [middle.select(c).scalar().alias(c) for c in ("count", "median")]
    return basic.select(*picked, "min", "max", "mean")


def length_histogram(docs: DataFrame, text: str = "text", bins: int = 15) -> DataFrame:
    """Equal-width bins between the smallest and largest length; the last one is closed."""
    lengths = docs.select(F.length(text).cast("bigint").alias("length"))
    limits = lengths.agg(F.struct(F.min("length").alias("lo"), F.max("length").alias("hi"))).scalar()
    placed = lengths.withColumn("r", limits)
    width = F.greatest(F.col("r.hi") - F.col("r.lo"), F.lit(1))
    bin_no = F.least(F.floor((F.col("length") - F.col("r.lo")) * bins / width), F.lit(bins - 1))
    return placed.groupBy(bin_no.alias("bin")).agg(
        F.count("*").alias("docs"), F.min("length").alias("shortest"), F.max("length").alias("longest")
    )


def stage_funnel(stages: DataFrame) -> DataFrame:
    """In / out / dropped per stage from one row per document: the last stage it reached (0..4)."""
    names = ("quality", "exact_dedup", "near_dedup")
    reached = stages.agg(*[F.count_if(F.col("reached") >= i).alias(f"r{i}") for i in range(len(names) + 1)])
    rows = [
        F.struct(F.lit(n).alias("stage"), F.col(f"r{i}").alias("n_in"), F.col(f"r{i + 1}").alias("n_out"),
                 (F.col(f"r{i}") - F.col(f"r{i + 1}")).alias("dropped"))
        for i, n in enumerate(names)
    ]
    return reached.select(F.inline(F.array(*rows)))


def removal_rates(funnel: DataFrame) -> DataFrame:
    """Duplicate rate and junk rate against the documents read."""
    n_in = F.max(F.when(F.col("stage") == "quality", F.col("n_in")))
    share = lambda *names: F.coalesce(
        F.try_divide(F.sum(F.when(F.col("stage").isin(*names), F.col("dropped")).otherwise(0)), n_in), F.lit(0.0)
    )
    return funnel.agg(
        n_in.alias("docs_in"), share("exact_dedup", "near_dedup").alias("dup_rate"), share("quality").alias("junk_rate")
    )


def health_status(value: Column, lo: Column, hi: Column) -> Column:
    return (
        F.when((value >= lo) & (value <= hi), F.lit("healthy"))
        .when((value < lo * 0.5) | (value > hi * 1.5), F.lit("bad"))
        .otherwise(F.lit("warn"))
    )


def health_bands(metrics: DataFrame, rules=HEALTH_RULES) -> DataFrame:
    """Long table (label, value, status, note) from one wide metrics row."""
    entries = [
        F.struct(F.lit(m).alias("label"), F.col(m).cast("double").alias("value"),
                 health_status(F.col(m), F.lit(lo), F.lit(hi)).alias("status"), F.lit(note).alias("note"))
        for m, lo, hi, note in rules
    ]
    return metrics.select(F.inline(F.array(*entries)))
