from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import load, query
from textloom.catalog import fragments as X
from textloom.functions import text as T
from textloom.functions.vectorized import CRC_TABLE, MERSENNE_31, MERSENNE_61, permutations, wide_permutations
from textloom.operators import dedup as D
from textloom.operators import links as L
from textloom.operators.cleaning import computed_once
from textloom.session import materialize

_COLLAPSED = X.sql_collapse("text")


def _documents(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


@query("d01_content_hash", f"SELECT doc_id, sha1({_COLLAPSED}) AS content_hash FROM documents")
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("d02_exact_dedup", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha1({_COLLAPSED})")
def _(spark, sf):
    return D.exact_dedup(_documents(spark, sf)).select("doc_id")


@query("d02_exact_groups", f"SELECT sha1({_COLLAPSED}) AS content_hash, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY 1")
def _(spark, sf):
    return D.first_by_content(_documents(spark, sf))


def _sql_sets(collapsed: str, short: str, table: str = "documents") -> str:
    """CTEs docs and grams: distinct 5-character pieces per document."""
    return f"""
docs AS MATERIALIZED (SELECT doc_id, s, string_split(s, '') AS c FROM (SELECT doc_id, {collapsed} AS s FROM {table})),
grams AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN {short} THEN [s] ELSE list_distinct(list_transform(
    list_zip(c[1:-5], c[2:-4], c[3:-3], c[4:-2], c[5:]), lambda x: x[1] || x[2] || x[3] || x[4] || x[5])) END) AS g
  FROM docs WHERE s <> '' OR NOT ({short}))"""


_SETS = _sql_sets(_COLLAPSED, "len(c) <= 5")


@query("d03_shingles", f"""
WITH {_SETS} SELECT doc_id, count(*)::BIGINT AS n_shingles, min(g) AS first, max(g) AS last, sum(length(g))::BIGINT AS chars FROM grams GROUP BY doc_id""")
def _(spark, sf):
    rows = computed_once(_documents(spark, sf), "s", T.shingles(F.col("text"))).where(F.size("s") > 0)
    return rows.select(
        "doc_id", F.size("s").cast("bigint").alias("n_shingles"), F.array_min("s").alias("first"), F.array_max("s").alias("last"),
        F.aggregate("s", F.lit(0).cast("bigint"), lambda n, g: n + F.length(g)).alias("chars"),
    )


def _sql_signatures(family, prime: int, reduced: str) -> str:
    """CTE sigs (doc_id, p, v): the hash family applied to CRC-32 of every piece."""
    a, b = family
    coefficients = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())))
    return f"""
crc_table AS MATERIALIZED (SELECT {CRC_TABLE.tolist()}::UBIGINT[] AS t),
crcs AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(0, strlen(g)), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::UBIGINT)),
      lambda s, x: xor(t[(xor(s, x) & 255)::BIGINT + 1], s >> 8)), 4294967295::UBIGINT) AS h
  FROM (SELECT DISTINCT g FROM grams), crc_table),
hashes AS MATERIALIZED (SELECT DISTINCT doc_id, {reduced} AS h FROM grams JOIN crcs USING (g)),
family(p, a, b) AS (VALUES {coefficients}),
measured AS (SELECT doc_id, p, min((a::UBIGINT * h + b) % {prime})::BIGINT AS v FROM hashes, family GROUP BY doc_id, p),
sigs AS MATERIALIZED (SELECT doc_id, p, coalesce(v, 0) AS v FROM (SELECT doc_id, p FROM docs, family) LEFT JOIN measured USING (doc_id, p))"""


_SIGS = f"{_SETS}, {_sql_signatures(permutations(), MERSENNE_31, f'h % {MERSENNE_31}')}"
_PAIRS = """
bands AS MATERIALIZED (SELECT doc_id, p // 4 AS band, list(v ORDER BY p) AS rows FROM sigs GROUP BY ALL),
cand AS MATERIALIZED (SELECT DISTINCT x.doc_id AS i, y.doc_id AS j FROM bands x JOIN bands y ON x.band = y.band AND x.rows = y.rows AND x.doc_id < y.doc_id),
pairs AS MATERIALIZED (SELECT i, j, avg((x.v = y.v)::INT) AS similarity FROM cand JOIN sigs x ON x.doc_id = i JOIN sigs y ON y.doc_id = j AND x.p = y.p GROUP BY i, j)"""


@query("d04_minhash_signatures", f"WITH {_SIGS} SELECT doc_id, string_agg(v, ',' ORDER BY p) AS sig FROM sigs GROUP BY doc_id")
def _(spark, sf):
    sigs = D.signatures(_documents(spark, sf))
    return sigs.select("doc_id", F.concat_ws(",", F.transform("sig", lambda v: v.cast("string"))).alias("sig"))


# Pairs are listed between the first documents of each distinct signature.
_REPS = "reps AS (SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, list(v ORDER BY p) AS s FROM sigs GROUP BY doc_id) GROUP BY s)"


def _representatives(spark, sf):
    return materialize(D.representatives(D.signatures(_documents(spark, sf))), "signatures")


@query("d05_signature_similarity", f"""
WITH {_SIGS}, {_REPS}, {_PAIRS} SELECT i, j, round(similarity, 6) AS similarity FROM pairs WHERE i IN (FROM reps) AND j IN (FROM reps)""")
def _(spark, sf):
    return D.candidate_pairs(_representatives(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query("d06_lsh_buckets", f"""
WITH {_SIGS}, {_PAIRS} SELECT band::BIGINT AS band, min(doc_id) AS first_doc, count(*)::BIGINT AS size FROM bands GROUP BY band, rows HAVING count(*) > 1""")
def _(spark, sf):
    cfg = D.NearDupConfig()
    rows = D.signatures(_documents(spark, sf)).select("doc_id", F.posexplode(D.band_slices(F.col("sig"), cfg)).alias("band", "rows"))
    return rows.groupBy("band", "rows").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("size")).where("size > 1").select(
        F.col("band").cast("bigint").alias("band"), "first_doc", "size")


@query("d06_lsh_candidates", f"WITH {_SIGS}, {_REPS}, {_PAIRS} SELECT i, j FROM cand WHERE i IN (FROM reps) AND j IN (FROM reps)")
def _(spark, sf):
    return D.candidate_pairs(_representatives(spark, sf)).select("i", "j")


# Every document with its class, so that pairs of classes can be expanded to documents.
_LINKS = """
signed AS MATERIALIZED (SELECT doc_id, list(v ORDER BY p) AS s FROM sigs GROUP BY doc_id),
touched AS (SELECT doc_id, count(*) AS n FROM (SELECT i AS doc_id FROM cand UNION ALL SELECT j FROM cand) GROUP BY doc_id)"""


@query("d06_document_links", f"""
WITH {_SIGS}, {_PAIRS}, {_LINKS}
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies, coalesce(n, 0)::BIGINT AS n_links
FROM signed LEFT JOIN touched USING (doc_id)""")
def _(spark, sf):
    return L.document_links(materialize(D.signatures(_documents(spark, sf)), "signatures", heavy=True))


_SCAN = """
edges AS MATERIALIZED (SELECT j, list(i) AS earlier FROM pairs WHERE similarity >= 0.6 GROUP BY j),
ordered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY j) AS k, j, earlier FROM edges),
scan(k, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT o.k, CASE WHEN len(list_filter(o.earlier, lambda e: NOT list_contains(s.dropped, e))) > 0 THEN list_append(s.dropped, o.j) ELSE s.dropped END
  FROM scan s JOIN ordered o ON o.k = s.k + 1),
gone AS (SELECT unnest(dropped) AS doc_id FROM scan WHERE k = (SELECT max(k) FROM scan))"""
_GREEDY = f"{_SIGS}, {_PAIRS}, {_SCAN}"


def near_sql(table: str) -> str:
    """CTEs up to gone(doc_id): what the sequential greedy scan of a table drops."""
    sets = _sql_sets(_COLLAPSED, "len(c) <= 5", table)
    return f"{sets}, {_sql_signatures(permutations(), MERSENNE_31, f'h % {MERSENNE_31}')}, {_PAIRS}, {_SCAN}"


@query("d07_near_dedup", f"WITH RECURSIVE {_GREEDY} SELECT doc_id FROM documents WHERE doc_id NOT IN (FROM gone)")
def _(spark, sf):
    return D.near_dedup_keys(_documents(spark, sf))


_UNTRIMMED = f"regexp_replace(text, '[{T.SPACE_CLASS}]+', ' ', 'g')"
_WIDE_SETS = _sql_sets(_UNTRIMMED, "len(c) < 5 OR s = ''")
_FIRSTS = """firsts AS MATERIALIZED (SELECT min(doc_id) AS doc_id, min(n) AS n, count(*) AS copies FROM (
  SELECT doc_id, count(*) AS n, list(g ORDER BY g) AS s FROM grams GROUP BY doc_id) GROUP BY s)"""


_EXACT = """
mine AS MATERIALIZED (SELECT doc_id, g FROM grams WHERE doc_id IN (SELECT doc_id FROM firsts)),
jaccards AS MATERIALIZED (SELECT i, j, shared.n::DOUBLE / (a.n + b.n - shared.n) AS jaccard
  FROM (SELECT x.doc_id AS i, y.doc_id AS j, count(*) AS n FROM mine x JOIN mine y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) shared
  JOIN firsts a ON a.doc_id = i JOIN firsts b ON b.doc_id = j),
exact AS MATERIALIZED (SELECT i, j, jaccard FROM jaccards WHERE jaccard > 0.5)"""
_TRIED = "tried AS MATERIALIZED (SELECT i, j FROM cand WHERE i IN (SELECT doc_id FROM firsts) AND j IN (SELECT doc_id FROM firsts))"


@query("d08_jaccard_pairs", f"WITH {_WIDE_SETS}, {_FIRSTS}, {_EXACT} SELECT i, j, round(jaccard, 6) AS jaccard FROM exact")
def _(spark, sf):
    sets = materialize(D.shingle_sets(_documents(spark, sf)), "shingles")
    return D.jaccard_pairs(sets).withColumn("jaccard", F.round("jaccard", 6))


_WIDE_SIGS = f"{_WIDE_SETS}, {_sql_signatures(wide_permutations(), MERSENNE_61, 'h')}"


@query("d08_document_links", f"""
WITH {_WIDE_SETS}, {_FIRSTS}, {_EXACT},
digests AS MATERIALIZED (SELECT d.doc_id, list(g ORDER BY g) FILTER (g IS NOT NULL) AS s FROM docs d LEFT JOIN grams USING (doc_id) GROUP BY d.doc_id),
classes AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies FROM digests),
touched AS (SELECT a AS class_id, sum(f.copies) AS n FROM (SELECT i AS a, j AS b FROM exact UNION ALL SELECT j, i FROM exact) JOIN firsts f ON f.doc_id = b GROUP BY a)
SELECT doc_id, class_id, copies, (coalesce(n, 0) + copies - 1)::BIGINT AS n_links FROM classes LEFT JOIN touched USING (class_id)""")
def _(spark, sf):
    docs = _documents(spark, sf)
    sets = materialize(D.shingle_sets(docs), "shingles", heavy=True)
    members = materialize(D.set_members(docs), "members")
    return L.pair_memberships(members, materialize(D.jaccard_pairs(sets), "exact"), D.set_classes(members))


@query("d09_lsh_jaccard_pairs", f"""
WITH {_WIDE_SIGS}, {_PAIRS}, {_FIRSTS}, {_EXACT}, {_TRIED} SELECT i, j, round(jaccard, 6) AS jaccard FROM exact SEMI JOIN tried USING (i, j)""")
def _(spark, sf):
    return D.lsh_jaccard_pairs(_documents(spark, sf)).withColumn("jaccard", F.round("jaccard", 6))


@query("d10_dedup_accuracy", f"""
WITH {_WIDE_SIGS}, {_PAIRS}, {_FIRSTS}, {_EXACT}, {_TRIED},
copied AS (SELECT doc_id, copies FROM firsts), inside AS (SELECT sum(copies * (copies - 1) // 2) AS inside FROM copied),
n AS (SELECT (SELECT sum(copies) FROM copied) AS docs,
  (SELECT coalesce(sum(a.copies * b.copies), 0) FROM tried JOIN copied a ON a.doc_id = i JOIN copied b ON b.doc_id = j) + inside AS candidates,
  (SELECT coalesce(sum(a.copies * b.copies), 0) FROM exact JOIN copied a ON a.doc_id = i JOIN copied b ON b.doc_id = j) + inside AS exact_pairs,
  (SELECT coalesce(sum(a.copies * b.copies), 0) FROM (SELECT i, j FROM exact SEMI JOIN tried USING (i, j)) JOIN copied a ON a.doc_id = i JOIN copied b ON b.doc_id = j) + inside AS lsh_pairs
  FROM inside)
SELECT (docs * (docs - 1) // 2)::BIGINT AS all_pairs, candidates::BIGINT AS candidates, exact_pairs::BIGINT AS exact_pairs, lsh_pairs::BIGINT AS lsh_pairs,
  lsh_pairs::BIGINT AS shared_pairs, round(candidates::DOUBLE / (docs * (docs - 1) // 2), 6) AS candidate_share,
  round(CASE WHEN exact_pairs > 0 THEN lsh_pairs::DOUBLE / exact_pairs ELSE 1 END, 6) AS recall FROM n""")
def _(spark, sf):
    docs = _documents(spark, sf)
    sets = materialize(D.shingle_sets(docs), "shingles")
    exact = materialize(D.jaccard_pairs(sets), "exact")
    return L.banded_accuracy(sets, D.wide_signatures(docs, sets), exact).select(
        "all_pairs", "candidates", "exact_pairs", "lsh_pairs", "shared_pairs",
        F.round("candidate_share", 6).alias("candidate_share"), F.round("recall", 6).alias("recall"))
