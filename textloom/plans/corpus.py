"""Corpus preparation and release decisions composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import dedup as near_copies
from textloom.operators import detectors, governance
from textloom.operators.cleaning import normalize_documents
from textloom.operators.statistics import stage_funnel
from textloom.operators.stream import placed_units, split_sizes
from textloom.operators.tokens import stream_vocabulary, token_dtype
from textloom.session import materialize


@dataclass(frozen=True)
class CorpusConfig:
    min_chars: int = T.MIN_CHARS
    max_symbol_ratio: float = T.MAX_SYMBOL_RATIO
    max_repeat_ratio: float = T.MAX_REPEAT_RATIO
    dedup: bool = True
    near: near_copies.NearDupConfig = field(default_factory=near_copies.NearDupConfig)
    val_frac: float = 0.1
    test_frac: float = 0.1


@dataclass(frozen=True)
class PreparedCorpus:
    survivors: DataFrame  # doc_id, text (normalised), other columns
    stages: DataFrame     # doc_id, reason, reached


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: CorpusConfig = CorpusConfig()) -> DataFrame:
    """Normalise and judge once; both dedup stages and the report read this table."""
    clean = normalize_documents(docs, text)
    reason = T.quality_reason(F.col(text), cfg.min_chars, cfg.max_symbol_ratio, cfg.max_repeat_ratio)
    return materialize(clean.withColumn("reason", reason), "judged", heavy=True)


def prepare_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: CorpusConfig = CorpusConfig(), near: bool = True) -> PreparedCorpus:
    """Clean, filter, drop exact and near copies; remember how far each document came."""
    table = judged(docs, key, text, cfg)
    good = table.where(F.col("reason") == "ok").drop("reason")
    reached = table.select(key, "reason", F.when(F.col("reason") == "ok", 1).otherwise(0).alias("reached"))
    if not cfg.dedup:
        return PreparedCorpus(good, reached.withColumn("reached", F.col("reached") * 3))
    unique = materialize(near_copies.exact_dedup(good, key, text), "unique", heavy=True)
    passed = unique.select(key).withColumn("second", F.lit(1))
    if near:
        kept = materialize(near_copies.near_dedup_keys(unique, key, text, cfg.near), "kept")
        survivors = unique.join(kept, key, "left_semi")
        passed = passed.join(kept.withColumn("third", F.lit(1)), key, "left")
    else:
        survivors, passed = unique, passed.withColumn("third", F.col("second"))
    stages = reached.join(passed, key, "left").select(
        key, "reason", (F.col("reached") + F.coalesce("second", F.lit(0)) + F.coalesce("third", F.lit(0))).alias("reached")
    )
    return PreparedCorpus(survivors, stages)


def funnel(prepared: PreparedCorpus) -> DataFrame:
    return stage_funnel(prepared.stages)


def stage_report(prepared: PreparedCorpus, threshold: float = 0.6) -> DataFrame:
    """Funnel rows with the drop reasons of the quality stage and the near threshold."""
    reasons = prepared.stages.where(F.col("reason") != "ok").groupBy("reason").agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))
    ).scalar()
    return funnel(prepared).select(
        "*", F.when(F.col("stage") == "quality", reasons).alias("reasons"),
        F.when(F.col("stage") == "near_dedup", F.lit(threshold)).alias("threshold"),
    )


def corpus_meta(survivors: DataFrame, docs_in: Column, key: str = "doc_id", text: str = "text", cfg: CorpusConfig = CorpusConfig(),
                tokenizer: str = "char", vocab_size: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """Documents, characters, tokens per split, vocabulary and characters per token."""
    totals = survivors.agg(F.count("*").alias("docs_out"), F.sum(F.length(text)).alias("chars"))
    total_chars = F.col("chars") + 2 * (F.col("docs_out") - 1)  # separators between documents
    vocab = stream_vocabulary(survivors, key, text).agg(F.count("*")).scalar() if vocab_size is None else vocab_size
    row = totals.select(docs_in.alias("docs_in"), "docs_out", total_chars.alias("total_chars"), vocab.alias("vocab_size"))
    row = row.withColumn("tokens", F.col("total_chars") if tokens is None else tokens)
    sizes = {n: hi - lo for n, (lo, hi) in split_sizes(F.col("tokens"), cfg.val_frac, cfg.test_frac).items()}
    return row.select(
        "vocab_size", F.lit(tokenizer).alias("tokenizer"), token_dtype(F.col("vocab_size")).alias("token_dtype"),
        "docs_in", "docs_out", "total_chars", *[s.alias(f"{n}_tokens") for n, s in sizes.items()],
        F.round(F.col("total_chars") / F.col("tokens"), 3).alias("chars_per_token"),
    )


def retrain_decision(docs: DataFrame, ledger: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text", auto: bool = True) -> DataFrame:
    """Data gate, registration, promotion gate and the resulting action per new entry.

    The data gate of the current documents replaces the recorded one; training
    and evaluation happen elsewhere and arrive as ``entries``.
    """
    passed = detectors.gate(detectors.detector_report(docs, text)).select("all_pass").scalar()
    gated = entries.withColumn("_pass", passed).withColumn(
        "lineage", F.col("lineage").withField("data_quality_gate", F.col("_pass"))
    ).drop("_pass")
    known = governance.register(ledger, gated)
    judged_entries = governance.with_gate(known).join(gated.select("model_digest"), "model_digest", "left_semi")
    go = F.lit("promote") if auto else F.lit("ready")
    return judged_entries.select(
        "model_digest", "short", "prod_loss", F.col("metrics.test_loss").alias("test_loss"), "reasons",
        F.when(F.size("reasons") == 0, go).otherwise(F.lit("blocked")).alias("action"),
    )


def corpus_splits(survivors: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Placed units of the surviving corpus, written down because splitting reads them repeatedly."""
    return materialize(placed_units(survivors, key, text), "units", heavy=True)
