from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import load, query
from textloom.catalog import fragments as X
from textloom.operators import drift as D
from textloom.operators.statistics import char_counts
from textloom.session import materialize

# Length bins of the numeric index, open at the end.
LENGTH_EDGES = [0.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 16000.0, 1e9]

_BASE = f"""
sampled AS (SELECT string_agg(text, {X.NL} || {X.NL} ORDER BY doc_id) AS body FROM documents),
base AS MATERIALIZED (SELECT ch, count(*) AS n, min(pos) AS first_at FROM (
  SELECT unnest(string_split(body, '')) AS ch, generate_subscripts(string_split(body, ''), 1) AS pos FROM sampled) GROUP BY ch),
best AS MATERIALIZED (SELECT ch, n::DOUBLE / (SELECT sum(n) FROM base) AS share FROM base ORDER BY n DESC, first_at LIMIT {D.TOP_BUCKETS}),
buckets AS (SELECT ch, share FROM best UNION ALL SELECT '', greatest(1e-6, 1 - sum(share)) FROM best)"""


def _sql_live(table: str, text: str) -> str:
    return f"live AS MATERIALIZED (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split({text}, '')) AS ch FROM {table}) WHERE ch <> '' GROUP BY ch)"


_PSI = """
seen AS (SELECT b.ch, b.share, CASE WHEN b.ch = '' THEN (SELECT sum(n) FROM live WHERE ch NOT IN (SELECT ch FROM best)) ELSE l.n END AS n
  FROM buckets b LEFT JOIN live l ON l.ch = b.ch),
rates AS (SELECT CASE WHEN ch = '' THEN share ELSE greatest(share, 1e-6) END AS b, greatest(coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM live), 1e-6) AS o FROM seen),
psi AS (SELECT sum((o - b) * ln(o / b)) AS psi FROM rates)"""
_OOV = "(SELECT coalesce(sum(n) FILTER (ch NOT IN (SELECT ch FROM base)), 0)::DOUBLE / sum(n) FROM live)"


def _baseline(spark, sf):
    return materialize(D.baseline_counts(load(spark, sf, "documents")), "baseline")


@query("i01_baseline_distribution", f"WITH {_BASE} SELECT ch, round(share, 9) AS share FROM buckets")
def _(spark, sf):
    return D.baseline_buckets(_baseline(spark, sf)).withColumn("share", F.round("share", 9))


@query("i02_oov_rate", f"WITH {_BASE}, {_sql_live('pages', 'html')} SELECT sum(n)::BIGINT AS chars_seen, round({_OOV}, 9) AS oov_rate FROM live")
def _(spark, sf):
    live = char_counts(load(spark, sf, "pages"), "html")
    return D.oov_rate(live, _baseline(spark, sf)).withColumn("oov_rate", F.round("oov_rate", 9))


@query("i03_character_psi", f"WITH {_BASE}, {_sql_live('conversations', 'text')}, {_PSI} SELECT round(psi, 6) AS psi FROM psi")
def _(spark, sf):
    live = char_counts(load(spark, sf, "conversations"))
    return D.character_psi(D.baseline_buckets(_baseline(spark, sf)), live).select(F.round("psi", 6).alias("psi"))


_EDGES = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(zip(LENGTH_EDGES, LENGTH_EDGES[1:])))


@query("i04_numeric_psi", f"""
WITH edges(bin, lo, hi) AS (VALUES {_EDGES}),
c AS (SELECT lang, bin, count(d.lang) AS n FROM edges e CROSS JOIN (SELECT DISTINCT lang FROM documents) l LEFT JOIN documents d USING (lang) WHERE length(d.text) >= lo AND length(d.text) < hi GROUP BY ALL),
full_c AS (SELECT l.lang, e.bin, coalesce(n, 0) AS n FROM edges e CROSS JOIN (SELECT DISTINCT lang FROM documents) l LEFT JOIN c USING (lang, bin)),
p AS (SELECT lang, bin, (n + 0.5) / (sum(n) OVER (PARTITION BY lang) + 0.5 * {len(LENGTH_EDGES) - 1}) AS p FROM full_c),
x AS (SELECT sum((b.p - a.p) * ln(b.p / a.p)) AS psi FROM p a JOIN p b USING (bin) WHERE a.lang = 'en' AND b.lang = 'fr')
SELECT round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'slight' ELSE 'severe' END AS level FROM x""")
def _(spark, sf):
    rows = load(spark, sf, "documents").select("lang", F.length("text").cast("double").alias("length"))
    return D.numeric_psi(rows, "length", LENGTH_EDGES, "lang", "en", "fr").withColumn("psi", F.round("psi", 6))


PSI_SQL = f"WITH {_BASE}, {_sql_live('conversations', 'text')}, {_PSI} SELECT psi FROM psi"
REPORT_SQL = f"""
WITH {_BASE}, {_sql_live('conversations', 'text')}, {_PSI}
SELECT (SELECT count(*) FROM conversations)::BIGINT AS requests, (SELECT sum(n) FROM live)::BIGINT AS chars_seen, round({_OOV}, 4) AS oov_rate,
  round(psi, 4) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'slight' ELSE 'severe' END AS level, psi >= 0.25 AS retrain_suggested FROM psi"""


@query("i05_drift_report", REPORT_SQL)
def _(spark, sf):
    turns, base = load(spark, sf, "conversations"), _baseline(spark, sf)
    return D.drift_report(turns.agg(F.count("*")).scalar(), D.baseline_buckets(base), base, char_counts(turns))
