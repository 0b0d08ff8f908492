from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import load, query
from textloom.catalog import fragments as X
from textloom.catalog.cleaning import _HITS, _sql_report
from textloom.operators import detectors as Q
from textloom.operators import governance as J
from textloom.plans.corpus import retrain_decision
from textloom.session import materialize

# One model per document source: losses and corpus facts are aggregates of its
# documents, the data gate is the detector gate of that source.
_CONFIG = """named_struct('block_size', 128, 'n_layer', cast(2 + first_doc % 5 AS int), 'n_head', 4, 'n_embd', cast(64 * (1 + first_doc % 3) AS int), 'dropout', 0.1D,
  'bias', first_doc % 2 = 0, 'vocab_size', 512, 'use_rmsnorm', true, 'use_swiglu', first_doc % 3 = 0, 'use_rope', true, 'n_kv_head', cast(NULL AS int), 'use_flash', false)"""


def _entries(spark, sf):
    docs = X.messy(load(spark, sf, "documents"))
    per = docs.groupBy(F.col("source").alias("run"))
    models = per.agg(F.sha2(F.concat(F.col("run"), F.lit(":"), F.sum(F.length("text")).cast("string")), 256).alias("digest"),
                     F.min("doc_id").alias("first_doc")).select(
        "run", "digest", F.concat(F.lit("2026-06-21T00:00:"), F.lpad(F.col("first_doc").cast("string"), 6, "0")).alias("created_at"),
        F.expr(_CONFIG).alias("config"), (F.col("first_doc") % 7 + 0.5).alias("params_M"), F.concat(F.lit("c"), F.col("first_doc").cast("string")).alias("code_commit"),
    )
    evaluations = per.agg(F.round(F.avg(F.log(F.length("text") + 1)), 4).alias("test_loss")).where("run <> 'src9'").select(
        "run", F.lit(None).cast("double").alias("val_loss"), "test_loss", F.round(F.exp("test_loss"), 2).alias("perplexity"))
    corpora = per.agg(
        F.count("*").alias("corpus_docs"), F.countDistinct("lang").alias("vocab_size"), F.sum(F.length("text").cast("bigint")).alias("train_tokens"),
        F.sha2(F.min("text"), 256).alias("data_sha"),
    ).withColumn("tokenizer", F.lit("char"))
    gates = Q.gate(Q.detector_report(docs, by=["source"]), ["source"]).select(F.col("source").alias("run"), "all_pass")
    return materialize(J.build_entries(models, evaluations, corpora, gates), "entries")


def _ledger(spark, sf):
    """All entries registered; the one with the largest digest is in production."""
    entries = _entries(spark, sf)
    top = entries.agg(F.max("model_digest")).scalar()
    return materialize(entries.withColumn("status", F.when(F.col("model_digest") == top, "production").otherwise(F.col("status"))), "ledger")


_ENTRIES = f"""{_HITS}, {_sql_report('source')},
gates AS (SELECT source, bool_and(pass) AS all_pass FROM report GROUP BY source),
facts AS (SELECT source, sha256(source || ':' || sum(length(text))) AS digest, '2026-06-21T00:00:' || right('000000' || min(doc_id), 6) AS created_at,
  'c' || min(doc_id) AS code_commit, CASE WHEN source <> 'src9' THEN round(avg(ln(length(text) + 1)), 4) END AS test_loss,
  min(doc_id) AS first_doc, count(*) AS corpus_docs, count(DISTINCT lang) AS vocab_size, sum(length(text)) AS train_tokens, sha256(min(text)) AS data_sha FROM messy GROUP BY source),
entries AS MATERIALIZED (SELECT 'sha256:' || digest AS model_digest, left(digest, 12) AS short, created_at, test_loss, round(exp(test_loss), 2) AS perplexity,
  'sha256:' || left(data_sha, 16) AS data_digest, corpus_docs::BIGINT AS corpus_docs, vocab_size::BIGINT AS vocab_size, train_tokens::BIGINT AS train_tokens,
  all_pass AS data_quality_gate, code_commit, (first_doc % 7 + 0.5)::DOUBLE AS "params_M", (2 + first_doc % 5)::INT AS n_layer, (64 * (1 + first_doc % 3))::INT AS n_embd,
  first_doc % 2 = 0 AS bias, first_doc % 3 = 0 AS use_swiglu FROM facts JOIN gates USING (source))"""
_LEDGER = f"""{_ENTRIES},
ledger AS MATERIALIZED (SELECT *, CASE WHEN model_digest = (SELECT max(model_digest) FROM entries) THEN 'production' ELSE 'registered' END AS status FROM entries)"""
_GATED = f"""{_LEDGER},
prod AS (SELECT model_digest AS pd, test_loss AS pl FROM ledger WHERE status = 'production'),
gated AS MATERIALIZED (SELECT *, CASE WHEN model_digest <> pd THEN pl END AS prod_loss, concat_ws('; ',
    CASE WHEN NOT data_quality_gate THEN '{J.REASON_DATA}' END, CASE WHEN test_loss IS NULL THEN '{J.REASON_NO_TEST}' END,
    CASE WHEN model_digest <> pd AND test_loss > pl + 0.05 THEN printf('regression: test_loss %.4f against production %.4f', test_loss, pl) END) AS reasons
  FROM ledger, prod)"""


GATE_SQL = f"WITH {_GATED} SELECT short, reasons FROM gated"


@query("j01_registry_entries", f"WITH {_ENTRIES} SELECT *, 'registered' AS status FROM entries")
def _(spark, sf):
    return _entries(spark, sf).select(
        "model_digest", "short", "status", "created_at", "metrics.test_loss", "metrics.perplexity", "lineage.data_digest", "lineage.corpus_docs",
        "lineage.vocab_size", "lineage.train_tokens", "lineage.data_quality_gate", "lineage.code_commit", "params_M",
        "config.n_layer", "config.n_embd", "config.bias", "config.use_swiglu",
    )


@query("j02_register", f"WITH {_LEDGER} SELECT model_digest, status FROM ledger")
def _(spark, sf):
    ledger = _ledger(spark, sf)
    known = ledger.where(F.col("status") == "production").unionByName(ledger.where(F.col("status") != "production"))
    return J.register(J.register(known, _entries(spark, sf)), _entries(spark, sf)).select("model_digest", "status")


@query("j03_promotion_gate", f"WITH {_GATED} SELECT model_digest, prod_loss, reasons FROM gated")
def _(spark, sf):
    return J.with_gate(_ledger(spark, sf)).select("model_digest", "prod_loss", F.concat_ws("; ", "reasons").alias("reasons"))


@query("j04_promote", f"""
WITH {_GATED}, hit AS (SELECT model_digest FROM gated WHERE reasons = '' AND status <> 'production' ORDER BY short LIMIT 1)
SELECT model_digest, CASE WHEN (SELECT count(*) FROM hit) = 0 THEN status WHEN model_digest = (FROM hit) THEN 'production'
  WHEN status = 'production' THEN 'archived' ELSE status END AS status FROM gated""")
def _(spark, sf):
    ledger = _ledger(spark, sf)
    free = J.with_gate(ledger).where((F.size("reasons") == 0) & (F.col("status") != "production"))
    short = free.agg(F.min("short")).first()[0]
    return J.promote(ledger, short or "none").select("model_digest", "status")


@query("j04_promote_blocked", f"WITH {_LEDGER} SELECT model_digest, status FROM ledger")
def _(spark, sf):
    ledger = _ledger(spark, sf)
    blocked = J.with_gate(ledger).where(F.size("reasons") > 0).agg(F.min("short")).first()[0]
    return J.promote(ledger, blocked or "none").select("model_digest", "status")


@query("j05_serving_audit", f"""
WITH {_LEDGER}, served AS (SELECT CASE WHEN e.event_type IN ('view', 'click') THEN (SELECT max(model_digest) FROM entries)
  WHEN e.event_type = 'signup' THEN (SELECT min(model_digest) FROM entries) ELSE 'sha256:' || e.event_type END AS served_digest, count(*) AS requests FROM events e GROUP BY 1)
SELECT served_digest, requests::BIGINT AS requests, coalesce(status, 'UNREGISTERED') AS status, status IS NOT NULL AS in_registry, test_loss, data_quality_gate
FROM served LEFT JOIN ledger ON served_digest = model_digest""")
def _(spark, sf):
    ledger = _ledger(spark, sf)
    lo, hi = ledger.agg(F.min("model_digest")).scalar(), ledger.agg(F.max("model_digest")).scalar()
    kind = F.col("event_type")
    digest = F.when(kind.isin("view", "click"), hi).when(kind == "signup", lo).otherwise(F.concat(F.lit("sha256:"), kind))
    served = load(spark, sf, "events").groupBy(kind).agg(F.count("*").alias("requests")).withColumn("served_digest", digest)
    return J.serving_audit(served.groupBy("served_digest").agg(F.sum("requests").alias("requests")), ledger)


@query("j06_strict_gate", f"""
WITH {_LEDGER}, cur AS (SELECT test_loss AS loss FROM ledger WHERE status = 'production')
SELECT e.event_type, CASE WHEN short IS NULL THEN 'UNREGISTERED' WHEN NOT data_quality_gate THEN 'BLOCK: data gate'
  WHEN coalesce(test_loss >= loss, true) THEN 'BLOCK: not better' ELSE 'PROMOTE' END AS verdict, coalesce(short, 'none') AS short
FROM (SELECT DISTINCT event_type FROM events) e LEFT JOIN ledger ON event_type <> 'error', cur""")
def _(spark, sf):
    ledger = _ledger(spark, sf)
    current = ledger.where(F.col("status") == "production").select("metrics.test_loss").scalar()
    kinds = load(spark, sf, "events").select("event_type").distinct()
    tracked = ledger.select(F.explode(F.array(*[F.lit(k) for k in ("view", "click", "signup", "purchase")])).alias("event_type"), "short",
                            F.col("metrics.test_loss").alias("val_loss"), F.col("lineage.data_quality_gate").alias("data_gate"))
    candidates = kinds.join(tracked, "event_type", "left")
    return J.strict_gate(candidates, current).select("event_type", "verdict", F.coalesce("short", F.lit("none")).alias("short"))


_CARD = " || chr(10) || ".join([
    "'# Model Card - `' || short || '`'", "''", "'| Field | Value |'", "'|---|---|'", "'| Digest | `' || model_digest || '` |'",
    "'| Status | **' || status || '** |'", "'| Created | ' || created_at || ' |'", "'| Parameters | ' || \"params_M\" || ' M |'",
    "'| Commit | `' || code_commit || '` |'", "''", "'## Architecture'",
    "'- n_layer=' || n_layer || ', n_head=4, n_kv_head=None, n_embd=' || n_embd || ', block_size=128, vocab_size=512, dropout=0.1, bias=' || bias",
    "'- use_rmsnorm=true, use_swiglu=' || use_swiglu || ', use_rope=true, use_flash=false'", "''", "'## Metrics'",
    "'- val_loss=None, test_loss=' || coalesce(test_loss::VARCHAR, 'None') || ', perplexity=' || coalesce(perplexity::VARCHAR, 'None')",
    "''", "'## Lineage'", "'- data digest: `' || data_digest || '`'",
    "'- documents: ' || corpus_docs || ', vocabulary: ' || vocab_size || ', train tokens: ' || train_tokens", "'- tokenizer: char'",
    "'- data quality gate: ' || CASE WHEN data_quality_gate THEN 'passed' ELSE 'failed or unknown' END", "''", "'## Limits'",
    *[f"'- {t}'" for t in J.CARD_LIMITS],
])


@query("j07_model_cards", f"WITH {_LEDGER} SELECT short, {_CARD} AS card FROM ledger")
def _(spark, sf):
    return J.model_cards(_ledger(spark, sf))


@query("j08_ledger_listing", f"""
WITH {_LEDGER} SELECT status = 'production' AS live, short, status, test_loss, data_quality_gate AS quality_gate, code_commit AS "commit" FROM ledger""")
def _(spark, sf):
    return J.ledger_listing(_ledger(spark, sf))


@query("j09_acceptance", f"""
WITH {X.JUDGED_MESSY}, m AS (
  SELECT 'docs_in' AS "check", count(*) AS actual, (SELECT count(*) FROM documents) AS expected FROM judged
  UNION ALL SELECT 'quality_dropped', count(*) FILTER (reason <> 'ok'), 3 FROM judged
  UNION ALL SELECT 'tags_left', count(*) FILTER (text LIKE '%<%'), 0 FROM judged
  UNION ALL SELECT 'nul_left', count(*) FILTER (contains(text, chr(7))), 0 FROM judged)
SELECT "check", expected::BIGINT AS expected, actual::BIGINT AS actual, CASE WHEN expected = actual THEN 'PASS' ELSE 'FAIL' END AS result FROM m""")
def _(spark, sf):
    from textloom.plans.corpus import judged

    docs = load(spark, sf, "documents")
    table = judged(X.messy(docs))
    measured = table.agg(
        F.count("*").alias("docs_in"), F.count_if(F.col("reason") != "ok").alias("quality_dropped"),
        F.count_if(F.contains("text", F.lit("<"))).alias("tags_left"), F.count_if(F.contains("text", F.lit("\x07"))).alias("nul_left"),
    ).unpivot([], ["docs_in", "quality_dropped", "tags_left", "nul_left"], "check", "actual")
    wanted = docs.agg(
        F.count("*").alias("docs_in"), F.lit(3).cast("bigint").alias("quality_dropped"), F.lit(0).cast("bigint").alias("tags_left"), F.lit(0).cast("bigint").alias("nul_left")
    ).unpivot([], ["docs_in", "quality_dropped", "tags_left", "nul_left"], "check", "expected")
    return J.acceptance(wanted, measured)


@query("j10_retrain_decision", f"""
WITH {_GATED}, g AS (SELECT bool_and(pass) AS ok FROM ({_sql_report().partition('(')[2].rpartition(')')[0]})),
r AS (SELECT model_digest, short, prod_loss, test_loss, concat_ws('; ', CASE WHEN NOT (SELECT ok FROM g) AND status <> 'production' THEN '{J.REASON_DATA}'
    WHEN status = 'production' AND NOT data_quality_gate THEN '{J.REASON_DATA}' END,
  CASE WHEN test_loss IS NULL THEN '{J.REASON_NO_TEST}' END,
  CASE WHEN prod_loss IS NOT NULL AND test_loss > prod_loss + 0.05 THEN printf('regression: test_loss %.4f against production %.4f', test_loss, prod_loss) END) AS reasons FROM gated)
SELECT *, CASE WHEN reasons = '' THEN 'promote' ELSE 'blocked' END AS action FROM r""")
def _(spark, sf):
    docs = X.messy(load(spark, sf, "documents"))
    ledger = _ledger(spark, sf)
    known = ledger.where(F.col("status") == "production")
    decisions = retrain_decision(docs, known, _entries(spark, sf))
    return decisions.withColumn("reasons", F.concat_ws("; ", "reasons"))
