from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import load, query
from textloom.catalog import fragments as X
from textloom.operators import trainsets as G
from textloom.operators.ordinals import with_ordinal
from textloom.session import materialize

# The test prose has no Chinese: the rule is told how its sentences look.
RULE = G.DefinitionRule(
    pattern=r"^([^\n]{1,60}?) (?:is|est|ist|es|the|la|und|de) (.{8,200}?\.)", bad_title=r"[,.;:?!0-9]",
    question="What is %s?", statement="%s is %s", stop=".",
)
BLOCK, BATCH = 128, 8

_DEFS = f"""
defs AS MATERIALIZED (SELECT doc_id, regexp_extract(text, '{RULE.pattern}', 1) AS title, regexp_extract(text, '{RULE.pattern}', 2) AS body
  FROM documents WHERE regexp_matches(text, '{RULE.pattern}'))"""
_ITEMS = f"""{_DEFS},
items AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM (
  SELECT * FROM defs WHERE NOT regexp_matches(title, '{RULE.bad_title}') QUALIFY row_number() OVER (PARTITION BY title ORDER BY doc_id) = 1
))"""


def _items(spark, sf):
    docs = load(spark, sf, "documents")
    return materialize(G.clean_titles(G.definitions(docs, RULE), RULE), "items")


@query("g01_definitions", f"WITH {_DEFS} SELECT * FROM defs")
def _(spark, sf):
    return G.definitions(load(spark, sf, "documents"), RULE)


@query("g02_clean_titles", f"WITH {_ITEMS} SELECT doc_id, title, body FROM items")
def _(spark, sf):
    return _items(spark, sf)


@query("g03_instruction_pairs", f"""
WITH {_ITEMS} SELECT doc_id, 'What is ' || title || '?' AS q, title || ' is ' || body AS a,
  '問：' || 'What is ' || title || '?' || {X.NL} || '答：' || title || ' is ' || body || {X.NL} || {X.NL} AS chat FROM items""")
def _(spark, sf):
    return G.instruction_pairs(_items(spark, sf), RULE).withColumn("chat", G.chat_text(F.col("q"), F.col("a")))


@query("g03_chat_exchanges", f"""
WITH {X.EXCHANGES} SELECT pair_id, sha1('問：' || prompt || {X.NL} || '答：' || response || {X.NL} || {X.NL}) AS chat FROM exchanges""")
def _(spark, sf):
    pairs = X.exchanges(load(spark, sf, "conversations"))
    return pairs.select("pair_id", F.sha1(G.chat_text(F.col("prompt"), F.col("response"))).alias("chat"))


@query("g04_held_out_split", f"""
WITH {X.EXCHANGES}, o AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS ordinal, count(*) OVER () AS n FROM exchanges)
SELECT pair_id, ordinal::BIGINT AS ordinal, ordinal < floor(n * 0.1) AS held_out FROM o""")
def _(spark, sf):
    pairs = materialize(X.exchanges(load(spark, sf, "conversations")).select("pair_id"), "pairs")
    return G.held_out_split(pairs, "pair_id")


@query("g05_off_topic_pairs", f"""
WITH {_ITEMS}, n AS (SELECT count(*) AS n FROM items)
SELECT a.doc_id, a.ordinal::BIGINT AS ordinal, 'What is ' || a.title || '?' AS prompt, a.title || ' is ' || a.body AS chosen, a.title || ' is ' || b.body AS rejected
FROM items a, n JOIN items b ON b.ordinal = (a.ordinal + 337) % n.n WHERE a.title <> b.title AND a.body <> b.body""")
def _(spark, sf):
    return G.off_topic_pairs(_items(spark, sf), RULE)


_LOOP = "repeat(left({0}, 2), greatest(1, (length({0}) - 1) // length(left({0}, 2)))::BIGINT) || '.'"


@query("g06_degenerate_pairs", f"""
WITH {_ITEMS} SELECT doc_id, 'What is ' || title || '?' AS prompt, title || ' is ' || body AS chosen, title || ' is ' || {_LOOP.format('body')} AS rejected FROM items""")
def _(spark, sf):
    return G.degenerate_pairs(_items(spark, sf), RULE)


def _points(text):
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def _examples(pairs):
    """Masked examples of both sides, tokens as code points."""
    example = G.masked_example(
        _points(F.format_string(G.PROMPT_TEMPLATE, "prompt")), _points(F.concat("response", F.lit(G.RESPONSE_SUFFIX))), BLOCK
    )
    return pairs.withColumn("example", example).select("*", "example.*").drop("example")


_FULL = f"('問：' || prompt || {X.NL} || '答：' || response || {X.NL} || {X.NL})"
_P = "(length(prompt) + 5)"


@query("g07_masked_examples", f"""
WITH {X.EXCHANGES}, e AS (SELECT pair_id, left({_FULL}, {BLOCK}) AS t, {_P} AS p FROM exchanges)
SELECT pair_id, length(t)::BIGINT AS n_ids, greatest(0, length(t) - p)::BIGINT AS n_masked,
  list_sum(list_transform(string_split(t, ''), lambda c: unicode(c)))::BIGINT AS id_sum FROM e""")
def _(spark, sf):
    rows = _examples(X.exchanges(load(spark, sf, "conversations")))
    return rows.select(
        "pair_id", F.size("ids").cast("bigint").alias("n_ids"), F.aggregate("mask", F.lit(0).cast("bigint"), lambda n, m: n + m).alias("n_masked"),
        F.aggregate("ids", F.lit(0).cast("bigint"), lambda n, m: n + m).alias("id_sum"),
    )


@query("g08_padded_batches", f"""
WITH {X.EXCHANGES}, o AS (SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS ordinal FROM exchanges),
s AS (SELECT ordinal // {BATCH} AS batch, ordinal * 2 AS "row", prompt, response FROM o
  UNION ALL SELECT ordinal // {BATCH}, ordinal * 2 + 1, prompt, {_LOOP.format('response')} FROM o),
e AS (SELECT batch, "row", length(left({_FULL}, {BLOCK})) AS n, {_P} AS p FROM s)
SELECT batch::BIGINT AS batch, "row"::BIGINT AS "row", (n - 1)::BIGINT AS last_idx, max(n) OVER (PARTITION BY batch)::BIGINT AS width,
  greatest(0, n - p)::BIGINT AS n_masked FROM e""")
def _(spark, sf):
    pairs = materialize(X.exchanges(load(spark, sf, "conversations")), "pairs")
    placed = with_ordinal(pairs, "pair_id").withColumn("chosen", F.col("response")).withColumn("rejected", G.looped_body(F.col("response"), "."))
    batches = G.padded_batches(_examples(G.interleaved(placed, "pair_id", BATCH)), "batch", "row")
    return batches.where((F.size("ids") == F.col("width")) & (F.size("mask") == F.col("width"))).select(
        "batch", "row", F.col("last_idx").cast("bigint").alias("last_idx"), F.col("width").cast("bigint").alias("width"),
        F.aggregate("mask", F.lit(0).cast("bigint"), lambda n, m: n + m).alias("n_masked"),
    )


@query("g09_control_axes", """
WITH o AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents),
m AS (SELECT a.*, b.text AS other, ('0x' || left(sha1('7:' || a.doc_id), 8))::BIGINT < 2147483648 AS heads FROM o a JOIN o b ON b.k = (a.k + 1) % a.n),
axes AS (SELECT doc_id, 'learnable' AS axis, k < n // 2 AS train, text AS chosen, text AS rejected FROM o
  UNION ALL SELECT doc_id, 'noise', k < n // 2, CASE WHEN heads THEN text ELSE other END, CASE WHEN heads THEN other ELSE text END FROM m)
SELECT doc_id, axis, train, sha1(chosen) AS chosen, sha1(list_aggregate(list_sort(string_split(rejected, '')), 'string_agg', '')) AS rejected_chars FROM axes""")
def _(spark, sf):
    axes = G.control_axes(load(spark, sf, "documents"))
    return axes.select(
        "doc_id", "axis", "train", F.sha1("chosen").alias("chosen"), F.sha1(F.array_join(F.sort_array(F.split("rejected", "")), "")).alias("rejected_chars")
    )
