from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import deduplication as D
from textloom.catalog import fragments as X
from textloom.catalog import load, query
from textloom.operators import statistics as S
from textloom.plans import corpus as P

_COUNTS = f"{X.STREAM}, counts AS (SELECT ch, count(*) AS n, min(pos) AS first_at FROM chars GROUP BY ch)"
_ENTROPY = "log2(sum(n)) - sum(n * log2(n)) / sum(n)"


@query("e01_char_entropy", f"""
WITH {_COUNTS} SELECT count(*)::BIGINT AS vocab_size, sum(n)::BIGINT AS total_chars, round({_ENTROPY}, 6) AS entropy FROM counts""")
def _(spark, sf):
    return S.entropy_of(S.stream_char_counts(load(spark, sf, "documents"))).withColumn("entropy", F.round("entropy", 6))


@query("e01_document_entropy", f"""
WITH counts AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY doc_id, ch)
SELECT doc_id, count(*)::BIGINT AS vocab_size, sum(n)::BIGINT AS total_chars, round(greatest({_ENTROPY}, 0), 6) AS entropy FROM counts GROUP BY doc_id""")
def _(spark, sf):
    counts = S.char_counts(load(spark, sf, "documents"), by=("doc_id",))
    return S.entropy_of(counts, ("doc_id",)).withColumn("entropy", F.round("entropy", 6))


@query("e02_entropy_efficiency", f"WITH {_COUNTS} SELECT round(({_ENTROPY}) / log2(count(*)), 3) AS efficiency FROM counts")
def _(spark, sf):
    e = S.entropy_of(S.stream_char_counts(load(spark, sf, "documents")))
    return e.select(S.entropy_efficiency(F.col("entropy"), F.col("vocab_size")).alias("efficiency"))


@query("e03_document_compression")
def _(spark, sf):
    docs = S.document_compression(load(spark, sf, "documents"))
    return docs.select("doc_id", F.round("compression_ratio", 6).alias("compression_ratio"))


@query("e03_corpus_compression")
def _(spark, sf):
    return S.corpus_compression(load(spark, sf, "documents")).withColumn("compression_ratio", F.round("compression_ratio", 6))


@query("e04_top_characters", f"WITH {_COUNTS} SELECT ch, n::BIGINT AS n FROM counts ORDER BY n DESC, first_at LIMIT 20")
def _(spark, sf):
    return S.top_characters(load(spark, sf, "documents"), top=20)


_MEDIAN = "list_sort(list(length(text)))[(count(*) // 2 + 1)::INT]::BIGINT"
_LENGTHS = f"""count(*)::BIGINT AS count, min(length(text))::BIGINT AS min, max(length(text))::BIGINT AS max,
  round(avg(length(text)), 1) AS mean, {_MEDIAN} AS median"""


@query("e05_length_summary", f"SELECT {_LENGTHS} FROM documents")
def _(spark, sf):
    return S.length_summary(load(spark, sf, "documents"))


@query("e05_length_summary_by_lang", f"SELECT lang, {_LENGTHS} FROM documents GROUP BY lang")
def _(spark, sf):
    return S.length_summary(load(spark, sf, "documents"), by=("lang",))


@query("e06_length_histogram", """
WITH l AS (SELECT length(text) AS n FROM documents), r AS (SELECT min(n) AS lo, max(n) AS hi FROM l)
SELECT least(floor((n - lo) * 15.0::DOUBLE / greatest(hi - lo, 1)), 14)::BIGINT AS bin, count(*)::BIGINT AS docs,
  min(n)::BIGINT AS shortest, max(n)::BIGINT AS longest FROM l, r GROUP BY 1""")
def _(spark, sf):
    return S.length_histogram(load(spark, sf, "documents")).withColumn("bin", F.col("bin").cast("bigint"))


def _exact_only(spark, sf) -> P.PreparedCorpus:
    return P.prepare_corpus(X.messy(load(spark, sf, "documents")), near=False)


_UNIQUE = f"""{X.JUDGED_MESSY},
good AS (SELECT * FROM judged WHERE reason = 'ok'),
survivors AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY sha1({X.sql_collapse('text')}) ORDER BY doc_id) = 1),
n AS (SELECT (SELECT count(*) FROM judged) AS a, (SELECT count(*) FROM good) AS b, (SELECT count(*) FROM survivors) AS c)"""
_FUNNEL = f"""{_UNIQUE},
funnel AS (SELECT 'quality' AS stage, a AS n_in, b AS n_out, a - b AS dropped FROM n
  UNION ALL SELECT 'exact_dedup', b, c, b - c FROM n UNION ALL SELECT 'near_dedup', c, c, 0 FROM n)"""


@query("e07_stage_funnel", f"WITH {_FUNNEL} SELECT stage, n_in::BIGINT AS n_in, n_out::BIGINT AS n_out, dropped::BIGINT AS dropped FROM funnel")
def _(spark, sf):
    return P.funnel(_exact_only(spark, sf))


_NEAR = D.near_sql("survivors")


@query("e07_stage_funnel_near", f"""
WITH RECURSIVE {_UNIQUE}, {_NEAR}, m AS (SELECT count(*) AS d FROM survivors WHERE doc_id NOT IN (FROM gone))
SELECT stage, i::BIGINT AS n_in, o::BIGINT AS n_out, (i - o)::BIGINT AS dropped FROM (
  SELECT 'quality' AS stage, a AS i, b AS o FROM n UNION ALL SELECT 'exact_dedup', b, c FROM n UNION ALL SELECT 'near_dedup', c, d FROM n, m)""")
def _(spark, sf):
    return P.funnel(P.prepare_corpus(X.messy(load(spark, sf, "documents"))))


@query("e08_removal_rates", f"WITH {_UNIQUE} SELECT a::BIGINT AS docs_in, round((b - c)::DOUBLE / a, 6) AS dup_rate, round((a - b)::DOUBLE / a, 6) AS junk_rate FROM n")
def _(spark, sf):
    rates = S.removal_rates(P.funnel(_exact_only(spark, sf)))
    return rates.select("docs_in", F.round("dup_rate", 6).alias("dup_rate"), F.round("junk_rate", 6).alias("junk_rate"))


_BANDED = """CASE WHEN value BETWEEN lo AND hi THEN 'healthy' WHEN value < lo * 0.5 OR value > hi * 1.5 THEN 'bad' ELSE 'warn' END"""


@query("e09_health_bands", f"""
WITH {_COUNTS}, m AS (SELECT sum(n)::DOUBLE AS total_chars, round(({_ENTROPY}) / log2(count(*)), 3) AS eff FROM counts),
d AS (SELECT (count(*) - count(DISTINCT sha1({X.sql_collapse('text')})))::DOUBLE / count(*) AS dup FROM documents),
v AS (SELECT 'total_chars' AS label, total_chars AS value, 1e6 AS lo, 1e12 AS hi FROM m
  UNION ALL SELECT 'entropy_efficiency', eff, 0.55, 0.97 FROM m UNION ALL SELECT 'dup_rate', round(dup, 3), 0.0, 0.30 FROM d)
SELECT label, value, {_BANDED} AS status FROM v""")
def _(spark, sf):
    docs = load(spark, sf, "documents")
    e = S.entropy_of(S.stream_char_counts(docs))
    from textloom.operators.dedup import first_by_content

    firsts = first_by_content(docs).agg(F.round(F.sum(F.col("copies") - 1) / F.sum("copies"), 3)).scalar()
    metrics = e.select("total_chars", S.entropy_efficiency(F.col("entropy"), F.col("vocab_size")).alias("entropy_efficiency"), firsts.alias("dup_rate"))
    rules = [r for r in S.HEALTH_RULES if r[0] != "compression_ratio"]
    return S.health_bands(metrics, rules).drop("note")


@query("e09_health_bands_all")
def _(spark, sf):
    docs = load(spark, sf, "documents")
    prepared = P.prepare_corpus(docs, near=False)
    e = S.entropy_of(S.stream_char_counts(prepared.survivors))
    ratio = S.corpus_compression(prepared.survivors).select(F.round("compression_ratio", 3)).scalar()
    rate = S.removal_rates(P.funnel(prepared)).select(F.round("dup_rate", 3)).scalar()
    return S.health_bands(e.select(
        "total_chars", S.entropy_efficiency(F.col("entropy"), F.col("vocab_size")).alias("entropy_efficiency"),
        ratio.alias("compression_ratio"), rate.alias("dup_rate"),
    ))


_META = f"""{_UNIQUE},
s AS (SELECT count(*) AS docs_out, sum(length(text)) + 2 * (count(*) - 1) AS total FROM survivors),
voc AS (SELECT count(DISTINCT ch) AS vocab_size FROM (
  SELECT unnest(string_split(text, '')) AS ch FROM survivors UNION ALL SELECT {X.NL} WHERE (SELECT docs_out FROM s) > 1) WHERE ch <> ''),
meta AS (SELECT vocab_size::BIGINT AS vocab_size, 'char' AS tokenizer, CASE WHEN vocab_size > 65535 THEN 'uint32' ELSE 'uint16' END AS token_dtype,
  a::BIGINT AS docs_in, docs_out::BIGINT AS docs_out, total::BIGINT AS total_chars,
  (total - 2 * greatest(1, floor(total * 0.1)))::BIGINT AS train_tokens, greatest(1, floor(total * 0.1))::BIGINT AS val_tokens,
  greatest(1, floor(total * 0.1))::BIGINT AS test_tokens, 1.0::DOUBLE AS chars_per_token FROM s, voc, n)"""


@query("e10_corpus_totals", f"WITH {_META} SELECT * FROM meta")
def _(spark, sf):
    prepared = _exact_only(spark, sf)
    return P.corpus_meta(prepared.survivors, prepared.stages.agg(F.count("*")).scalar())
