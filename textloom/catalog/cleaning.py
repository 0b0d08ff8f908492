from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import load, query
from textloom.catalog import fragments as X
from textloom.functions import text as T
from textloom.operators import cleaning as C
from textloom.operators import detectors as Q
from textloom.operators.ordinals import with_ordinal
from textloom.session import materialize


def _digest(df, key="doc_id", text="text"):
    return df.select(key, F.length(text).cast("bigint").alias("n_chars"), F.sha1(text).alias("sha"))


def _sql_digest(source: str, key: str = "doc_id", text: str = "text") -> str:
    return f"SELECT {key}, length({text})::BIGINT AS n_chars, sha1({text}) AS sha FROM {source}"


@query("b01_unicode_nfc", _sql_digest(
    "(SELECT doc_id, nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776))) AS text FROM documents)"))
def _(spark, sf):
    docs = load(spark, sf, "documents")
    split = F.replace(F.replace("text", F.lit("\u00e9"), F.lit("e\u0301")), F.lit("\u00fc"), F.lit("u\u0308"))
    return _digest(docs.withColumn("text", T.to_nfc(split)))


@query("b02_strip_html", _sql_digest("(SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages)", "page_id"))
def _(spark, sf):
    return _digest(load(spark, sf, "pages").withColumn("text", T.strip_html(F.col("html"))), "page_id")


@query("b03_language_variants", _sql_digest("""(
  SELECT doc_id, left(text, 10) || CASE lang
    WHEN 'en' THEN source WHEN 'fr' THEN 'tw ' || source WHEN 'de' THEN 'second' ELSE '' END || substr(text, 11) AS text
  FROM documents)"""))
def _(spark, sf):
    docs = load(spark, sf, "documents")
    markup = (
        F.when(F.col("lang") == "en", F.concat(F.lit("-{"), F.col("source"), F.lit("}-")))
        .when(F.col("lang") == "fr", F.concat(F.lit("-{zh-cn:cn;zh-tw: tw "), F.col("source"), F.lit(" }-")))
        .when(F.col("lang") == "de", F.lit("-{zh-cn:first;zh-sg:other;zh-cn:second}-"))
        .otherwise(F.lit("-{zh-cn:;zh-hk: }-"))
    )
    marked = F.concat(F.left("text", F.lit(10)), markup, F.substr(F.col("text"), F.lit(11)))
    return _digest(docs.withColumn("text", T.resolve_variants(marked)))


@query("b04_strip_controls", _sql_digest("documents"))
def _(spark, sf):
    noisy = F.replace(F.replace("text", F.lit("e"), F.lit("e\x07")), F.lit(" "), F.lit("\x7f \x1f"))
    return _digest(load(spark, sf, "documents").withColumn("text", T.strip_controls(noisy)))


_LOOSE = "chr(12288) || replace(replace(text, '. ', '. ' || chr(13) || chr(10) || chr(9) || chr(10) || chr(10)), ', ', ',  ' || chr(160) || chr(10)) || ' '"


@query("b05_tidy_space", _sql_digest(f"(SELECT doc_id, {X.sql_tidy(_LOOSE)} AS text FROM documents)"))
def _(spark, sf):
    loose = F.replace(F.replace("text", F.lit(". "), F.lit(". \r\n\t\n\n")), F.lit(", "), F.lit(",  \xa0\n"))
    loose = F.concat(F.lit("　"), loose, F.lit(" "))
    return _digest(load(spark, sf, "documents").withColumn("text", T.tidy_space(loose)))


@query("b06_normalize_pages", _sql_digest(f"(SELECT page_id, {X.sql_normalize('html')} AS text FROM pages)", "page_id"))
def _(spark, sf):
    return _digest(C.normalize_documents(load(spark, sf, "pages"), "html"), "page_id", "html")


@query("b06_normalize_documents", f"WITH {X.MESSY} " + _sql_digest(f"(SELECT doc_id, {X.sql_normalize('text')} AS text FROM messy)"))
def _(spark, sf):
    return _digest(C.normalize_documents(X.messy(load(spark, sf, "documents"))))


@query("b07_symbol_ratio", f"""
SELECT 'page' AS kind, page_id AS id, round({X.sql_symbols('html')}, 6) AS symbol_ratio FROM pages
UNION ALL SELECT 'document', doc_id, round({X.sql_symbols('text')}, 6) FROM documents""")
def _(spark, sf):
    pages = load(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = load(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return pages.unionByName(docs).select("kind", "id", F.round(T.symbol_ratio(F.col("text")), 6).alias("symbol_ratio"))


@query("b08_top_char_ratio", f"""
SELECT doc_id, round(coalesce(top_share, 1.0), 6) AS top_char_ratio
FROM documents LEFT JOIN {X.sql_top_share('documents')} USING (doc_id)""")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.round(T.repeat_ratio(F.col("text")), 6).alias("top_char_ratio"))


@query("b09_quality_verdict", f"WITH {X.JUDGED_MESSY} SELECT doc_id, reason = 'ok' AS keep, reason FROM judged")
def _(spark, sf):
    clean = C.normalize_documents(X.messy(load(spark, sf, "documents")))
    return C.with_verdict(clean).select("doc_id", "keep", "reason")


@query("b10_quality_filter", f"""
WITH {X.JUDGED_MESSY} SELECT reason, count(*)::BIGINT AS dropped FROM judged WHERE reason <> 'ok' GROUP BY reason""")
def _(spark, sf):
    clean = C.normalize_documents(X.messy(load(spark, sf, "documents")))
    return C.dropped_by_reason(C.with_verdict(clean))


@query("b10_quality_survivors", f"WITH {X.JUDGED_MESSY} {_sql_digest('judged')} WHERE reason = 'ok'")
def _(spark, sf):
    return _digest(C.quality_filter(C.normalize_documents(X.messy(load(spark, sf, "documents")))))


# ---- detectors -------------------------------------------------------------

_TESTS = {
    "wiki_markup": "regexp_matches(text, '-\\{[^}]*\\}-')",
    "html_residue": "regexp_matches(text, '<[^>]+>')",
    "control_chars": "regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')",
    "url": "regexp_matches(text, 'https?://')",
    "symbol_spam": f"{X.sql_symbols('text')} > 0.3",
    "high_repetition": "coalesce(top_share, 1.0) > 0.3",
    "too_short": f"length({X.sql_strip('text')}) < 50",
}
_HITS = f"""{X.MESSY},
hits AS MATERIALIZED (SELECT doc_id, source, lang, text, {', '.join(f'{t} AS {n}' for n, t in _TESTS.items())}
  FROM messy LEFT JOIN {X.sql_top_share('messy')} USING (doc_id))"""
_LIMITS = ", ".join(f"('{d.name}', {d.threshold_pct}::DOUBLE)" for d in Q.DETECTORS)


def _sql_report(by: str = "") -> str:
    group = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    parts = " UNION ALL ".join(
        f"SELECT {group}'{n}' AS name, count(*) FILTER ({n})::BIGINT AS hits, count(*)::BIGINT AS total_docs FROM hits {tail}" for n in _TESTS
    )
    return f"""report AS (
  SELECT {group}name, hits, total_docs, round(hits * 100.0::DOUBLE / total_docs, 2) AS pct, threshold_pct,
         hits::DOUBLE / total_docs * 100 <= threshold_pct AS pass
  FROM ({parts}) JOIN (VALUES {_LIMITS}) l(name, threshold_pct) USING (name))"""


def _messy(spark, sf):
    return X.messy(load(spark, sf, "documents"))


def _register_detector(number: int, d: Q.Detector) -> None:
    @query(f"c0{number}_{d.name}", f"WITH {_HITS} SELECT doc_id, source FROM hits WHERE {d.name}")
    def _(spark, sf):
        return _messy(spark, sf).where(d.test(F.col("text"))).select("doc_id", "source")


for _number, _detector in enumerate(Q.DETECTORS, 1):
    _register_detector(_number, _detector)


@query("c08_detector_report", f"WITH {_HITS}, {_sql_report()} SELECT * FROM report")
def _(spark, sf):
    return Q.detector_report(_messy(spark, sf)).drop("note")


_PAGE_HITS = f"""
page_text AS (SELECT page_id, html AS text FROM pages),
hits AS MATERIALIZED (SELECT page_id, {', '.join(f'{t} AS {n}' for n, t in _TESTS.items())}
  FROM page_text LEFT JOIN {X.sql_top_share('page_text', 'page_id')} USING (page_id))"""


@query("c08_report_document", f"""
WITH {_PAGE_HITS}, {_sql_report()} SELECT total_docs, (SELECT bool_and(pass) FROM report) AS all_pass, name, hits, pct, pass, least(hits, 3)::BIGINT AS samples FROM report""")
def _(spark, sf):
    document = Q.report_document(load(spark, sf, "pages"), "page_id", "html")
    return document.select("total_docs", "all_pass", F.inline("detectors")).select(
        "total_docs", "all_pass", "name", "hits", "pct", "pass", F.size("samples").cast("bigint").alias("samples"))


@query("c08_gate", f"""
WITH {_HITS}, {_sql_report('source')}
SELECT source, max(total_docs)::BIGINT AS total_docs, bool_and(pass) AS all_pass FROM report GROUP BY source""")
def _(spark, sf):
    return Q.gate(Q.detector_report(_messy(spark, sf), by=["source"]), ["source"])


def _sql_sample(d: Q.Detector) -> str:
    if d.pattern is None:
        cut = f"left(replace({X.sql_strip('text')}, {X.NL}, ' '), 80)"
    else:
        cut = f"'…' || replace(regexp_extract(text, '(?s).{{0,25}}?(?:{d.pattern}).{{0,25}}'), {X.NL}, ' ') || '…'"
    return f"""SELECT '{d.name}' AS name, row_number() OVER (ORDER BY doc_id) AS rank, doc_id, {cut} AS sample
  FROM hits WHERE {d.name} QUALIFY rank <= 3"""


@query("c09_problem_samples", f"WITH {_HITS} " + " UNION ALL ".join(f"({_sql_sample(d)})" for d in Q.DETECTORS))
def _(spark, sf):
    return Q.problem_samples(_messy(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


_LABELS = f"""
WITH {_HITS}, {_sql_report('source')},
numbered AS (SELECT source AS label, row_number() OVER (ORDER BY source) AS seq, bool_and(pass) AS all_pass,
  max(pct) FILTER (name = 'url') AS url_pct, max(pct) FILTER (name = 'too_short') AS too_short_pct FROM report GROUP BY source)"""


@query("c10_report_history", f"""{_LABELS},
entry AS (SELECT 'src13' AS label, bool_and(pass) AS all_pass, max(pct) FILTER (name = 'url') AS url_pct,
  max(pct) FILTER (name = 'too_short') AS too_short_pct FROM (
    SELECT name, round(hits::DOUBLE / total_docs * 100, 2) AS pct, hits::DOUBLE / total_docs * 100 <= threshold_pct AS pass
    FROM (SELECT name, sum(hits) AS hits, sum(total_docs) AS total_docs, max(threshold_pct) AS threshold_pct FROM report GROUP BY name))),
merged AS (SELECT label, seq, all_pass, url_pct, too_short_pct FROM numbered WHERE label <> 'src13'
  UNION ALL SELECT label, (SELECT max(seq) + 1 FROM numbered), all_pass, url_pct, too_short_pct FROM entry)
SELECT label, seq::BIGINT AS seq, all_pass, url_pct, too_short_pct FROM merged ORDER BY seq DESC LIMIT 10""")
def _(spark, sf):
    docs = _messy(spark, sf)
    per_source = Q.detector_report(docs, by=["source"]).groupBy("source").agg(
        F.bool_and("pass").alias("all_pass"), F.map_from_entries(F.collect_list(F.struct("name", "pct"))).alias("pct")
    )
    # One history row per source label, numbered in label order.
    labels = with_ordinal(materialize(per_source, "history"), "source")
    history = labels.select(F.col("source").alias("label"), (F.col("ordinal") + 1).alias("seq"), "all_pass", "pct")
    entry = Q.history_entry(Q.detector_report(docs), F.lit("src13"))
    return Q.upsert_history(history, entry).select(
        "label", "seq", "all_pass", F.col("pct")["url"].alias("url_pct"), F.col("pct")["too_short"].alias("too_short_pct")
    )


@query("c11_before_after", f"""
WITH {_HITS}, {_sql_report()}, before_rows AS (SELECT name, pct, threshold_pct FROM report),
messy2 AS (SELECT doc_id, {X.sql_normalize('text')} AS text FROM messy),
hits2 AS (SELECT {', '.join(f'{t} AS {n}' for n, t in _TESTS.items())} FROM messy2 LEFT JOIN {X.sql_top_share('messy2')} USING (doc_id)),
after_rows AS ({' UNION ALL '.join(f"SELECT '{n}' AS name, round(avg({n}::INT) * 100, 2) AS after FROM hits2" for n in _TESTS)})
SELECT name, pct AS before, after, threshold_pct FROM before_rows JOIN after_rows USING (name)""")
def _(spark, sf):
    raw = _messy(spark, sf)
    before = Q.detector_report(raw).withColumn("label", F.lit("before"))
    after = Q.detector_report(C.normalize_documents(raw)).withColumn("label", F.lit("after"))
    return Q.compare_labels(before.unionByName(after), ["before", "after"])
