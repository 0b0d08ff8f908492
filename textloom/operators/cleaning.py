"""Normalisation and quality filtering of a document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Set a column behind a generator, which projections are not merged through.

    A plain projection of a long regex chain would be inlined into every later
    reference and evaluated once per reference.
    """
    order = df.columns if name in df.columns else [*df.columns, name]
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name)).select(*order)


def normalize_documents(docs: DataFrame, text: str = "text", html: bool = True) -> DataFrame:
    """NFC, tags, variant markup, control characters, spaces - in this order."""
    t = T.to_nfc(F.col(text))
    plain = computed_once(docs, text, T.strip_html(t) if html else t)
    return computed_once(plain, text, T.tidy_space(T.strip_controls(T.resolve_variants(F.col(text)))))


def with_verdict(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    return docs.withColumn("reason", T.quality_reason(F.col(text), **limits)).withColumn(
        "keep", F.col("reason") == "ok"
    )


def quality_filter(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    return with_verdict(docs, text, **limits).where("keep").drop("keep", "reason")


def dropped_by_reason(judged: DataFrame) -> DataFrame:
    return judged.where(~F.col("keep")).groupBy("reason").agg(F.count("*").alias("dropped"))
