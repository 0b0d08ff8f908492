"""Model ledger: entries, promotion gates, audit, cards and acceptance checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gate tolerance and the reason texts of the ledger.
REGRESSION_TOLERANCE = 0.05
REASON_DATA = "data quality gate not passed"
REASON_NO_TEST = "test evaluation missing"
UNREGISTERED = "UNREGISTERED"

ENTRY_SCHEMA = """
    model_digest STRING, short STRING, status STRING, created_at STRING,
    config STRUCT<block_size: INT, n_layer: INT, n_head: INT, n_embd: INT, dropout: DOUBLE, bias: BOOLEAN,
                  vocab_size: INT, use_rmsnorm: BOOLEAN, use_swiglu: BOOLEAN, use_rope: BOOLEAN,
                  n_kv_head: INT, use_flash: BOOLEAN>,
    params_M DOUBLE,
    metrics STRUCT<val_loss: DOUBLE, test_loss: DOUBLE, perplexity: DOUBLE>,
    lineage STRUCT<data_digest: STRING, corpus_docs: BIGINT, vocab_size: BIGINT, train_tokens: BIGINT,
                   tokenizer: STRING, data_quality_gate: BOOLEAN, code_commit: STRING>
"""


def build_entries(models: DataFrame, evaluations: DataFrame, corpora: DataFrame, gates: DataFrame, on: str = "run") -> DataFrame:
    """Assemble ledger entries (``ENTRY_SCHEMA``); a missing report leaves NULLs, which later fail the gate."""
    joined = models.join(evaluations, on, "left").join(corpora, on, "left").join(gates, on, "left")
    return joined.select(
        F.concat(F.lit("sha256:"), "digest").alias("model_digest"),
        F.substring("digest", 1, 12).alias("short"),
        F.lit("registered").alias("status"),
        F.col("created_at"),
        F.col("config"),
        F.col("params_M"),
        F.struct("val_loss", "test_loss", "perplexity").alias("metrics"),
        F.struct(
            F.concat(F.lit("sha256:"), F.substring("data_sha", 1, 16)).alias("data_digest"),
            "corpus_docs", "vocab_size", "train_tokens", "tokenizer", F.col("all_pass").alias("data_quality_gate"), "code_commit",
        ).alias("lineage"),
    )


def register(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Append entries whose digest is new, the first created of each; registering twice changes nothing."""
    row = F.struct(*[F.col(c) for c in ledger.columns])
    first = entries.groupBy("model_digest").agg(F.min_by(row, F.struct("created_at", "short")).alias("row")).select("row.*")
    return ledger.unionByName(first.join(ledger.select("model_digest"), "model_digest", "left_anti").select(*ledger.columns))


def gate_reasons(data_gate: Column, test_loss: Column, prod_loss: Column, tol: float = REGRESSION_TOLERANCE) -> Column:
    """Array of reasons that block promotion; empty means free to go."""
    worse = test_loss > prod_loss + tol
    regression = F.format_string("regression: test_loss %.4f against production %.4f", test_loss, prod_loss)
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(data_gate, F.lit(False)), F.lit(REASON_DATA)),
            F.when(test_loss.isNull(), F.lit(REASON_NO_TEST)),
            F.when(F.coalesce(worse, F.lit(False)), regression),
        )
    )


def with_gate(ledger: DataFrame, tol: float = REGRESSION_TOLERANCE) -> DataFrame:
    """Every entry judged against the first production entry other than itself."""
    production = ledger.where(F.col("status") == "production").orderBy("created_at", "model_digest").limit(2)
    pair = F.array_sort(F.collect_list(F.struct("created_at", "model_digest", F.col("metrics.test_loss").alias("test_loss"))))
    serving = production.agg(pair.alias("p")).scalar()
    rivals = F.filter("_serving", lambda p: p["model_digest"] != F.col("model_digest"))
    judged = ledger.withColumn("_serving", serving).withColumn("prod_loss", F.try_element_at(rivals, F.lit(1))["test_loss"])
    reasons = gate_reasons(F.col("lineage.data_quality_gate"), F.col("metrics.test_loss"), F.col("prod_loss"), tol)
    return judged.withColumn("reasons", reasons).drop("_serving")


def promote(ledger: DataFrame, short: str, tol: float = REGRESSION_TOLERANCE) -> DataFrame:
    """Ledger after promoting the first entry whose short digest starts with ``short``.

    Blocked or unknown: unchanged.  Otherwise every production entry is
    archived and the entry becomes production.
    """
    judged = with_gate(ledger, tol)
    hit = judged.where(F.col("short").startswith(short)).orderBy("created_at", "model_digest").limit(1)
    target = hit.where(F.size("reasons") == 0).select("model_digest").scalar()
    status = (
        F.when(F.col("_target").isNull(), F.col("status"))
        .when(F.col("model_digest") == F.col("_target"), F.lit("production"))
        .when(F.col("status") == "production", F.lit("archived"))
        .otherwise(F.col("status"))
    )
    return ledger.withColumn("_target", target).withColumn("status", status).drop("_target")


def serving_audit(served: DataFrame, ledger: DataFrame, digest: str = "served_digest") -> DataFrame:
    """Registry status of every served digest; unknown digests are flagged."""
    facts = ledger.select(
        F.col("model_digest").alias(digest), F.col("status"), F.col("metrics.test_loss").alias("test_loss"),
        F.col("lineage.data_quality_gate").alias("data_quality_gate"),
    )
    return served.join(facts, digest, "left").withColumn("in_registry", F.col("status").isNotNull()).withColumn(
        "status", F.coalesce("status", F.lit(UNREGISTERED))
    )


def strict_gate(candidates: DataFrame, current_loss: Column) -> DataFrame:
    """Variant gate: registered, data gate passed and strictly better than the current loss."""
    verdict = (
        F.when(F.col("val_loss").isNull() & F.col("data_gate").isNull(), F.lit(UNREGISTERED))
        .when(~F.coalesce("data_gate", F.lit(False)), F.lit("BLOCK: data gate"))
        .when(F.coalesce(F.col("val_loss") >= current_loss, F.lit(True)), F.lit("BLOCK: not better"))
        .otherwise(F.lit("PROMOTE"))
    )
    return candidates.withColumn("verdict", verdict)


# What every card says about the limits of its model.
CARD_LIMITS = (
    "trained on one corpus; other domains are untested",
    "too small for unattended text generation",
)
_SHAPE = ("n_layer", "n_head", "n_kv_head", "n_embd", "block_size", "vocab_size", "dropout", "bias")
_PARTS = ("use_rmsnorm", "use_swiglu", "use_rope", "use_flash")


def model_cards(ledger: DataFrame, limits: Sequence[str] = CARD_LIMITS) -> DataFrame:
    """One markdown card per entry: identity, size, architecture, metrics, lineage and limits."""
    v = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    pairs = lambda names, at: F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), v(f"{at}.{n}")) for n in names])
    gate = F.when(F.col("lineage.data_quality_gate"), F.lit("passed")).otherwise(F.lit("failed or unknown"))
    lines = [
        F.concat(F.lit("# Model Card - `"), v("short"), F.lit("`")),
        F.lit(""),
        F.lit("| Field | Value |"),
        F.lit("|---|---|"),
        F.concat(F.lit("| Digest | `"), v("model_digest"), F.lit("` |")),
        F.concat(F.lit("| Status | **"), v("status"), F.lit("** |")),
        F.concat(F.lit("| Created | "), v("created_at"), F.lit(" |")),
        F.concat(F.lit("| Parameters | "), v("params_M"), F.lit(" M |")),
        F.concat(F.lit("| Commit | `"), v("lineage.code_commit"), F.lit("` |")),
        F.lit(""),
        F.lit("## Architecture"),
        F.concat(F.lit("- "), pairs(_SHAPE, "config")),
        F.concat(F.lit("- "), pairs(_PARTS, "config")),
        F.lit(""),
        F.lit("## Metrics"),
        F.concat(F.lit("- "), pairs(("val_loss", "test_loss", "perplexity"), "metrics")),
        F.lit(""),
        F.lit("## Lineage"),
        F.concat(F.lit("- data digest: `"), v("lineage.data_digest"), F.lit("`")),
        F.concat(F.lit("- documents: "), v("lineage.corpus_docs"), F.lit(", vocabulary: "), v("lineage.vocab_size"),
                 F.lit(", train tokens: "), v("lineage.train_tokens")),
        F.concat(F.lit("- tokenizer: "), v("lineage.tokenizer")),
        F.concat(F.lit("- data quality gate: "), gate),
        F.lit(""),
        F.lit("## Limits"),
        *[F.lit(f"- {text}") for text in limits],
    ]
    return ledger.select("short", F.concat_ws("\n", *lines).alias("card"))


def ledger_listing(ledger: DataFrame) -> DataFrame:
    """Status flag, short digest, test loss, gate and commit per entry."""
    return ledger.select(
        (F.col("status") == "production").alias("live"), "short", "status", F.col("metrics.test_loss").alias("test_loss"),
        F.col("lineage.data_quality_gate").alias("quality_gate"), F.col("lineage.code_commit").alias("commit"),
    )


def acceptance(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected against actual per check; a check without a measurement fails."""
    return expected.join(actual, "check", "left").withColumn(
        "result", F.when(F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)), F.lit("PASS")).otherwise(F.lit("FAIL"))
    )


def acceptance_total(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count("*").alias("checks"), F.count_if(F.col("result") == "PASS").alias("passed"), F.bool_and(F.col("result") == "PASS").alias("accepted")
    )
