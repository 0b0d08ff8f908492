from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import load, query
from textloom.catalog import fragments as X
from textloom.functions.coding import merge_column
from textloom.operators import bpe as B
from textloom.operators import stream as ST
from textloom.operators import tokens as K
from textloom.operators.statistics import char_counts
from textloom.plans.corpus import corpus_splits
from textloom.session import materialize, scratch_path

_VOCAB = f"{X.STREAM}, vocab AS (SELECT row_number() OVER (ORDER BY ch) - 1 AS token_id, ch AS token FROM (SELECT DISTINCT ch FROM chars))"
BLOCK = 64
MERGES = 500  # fixed value: the size of the vocabulary that is trained by default
CHECKED = 3  # merges that SQL follows one by one
_models: dict = {}


def _documents(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


def _pieces(spark, sf):
    return ST.split_pieces(corpus_splits(_documents(spark, sf)))


def _model(spark, sf) -> B.BpeModel:
    """Several queries report on the same training run."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        _models[key] = B.train_bpe(_documents(spark, sf), MERGES)
    return _models[key]


@query("f01_char_vocabulary", f"WITH {_VOCAB} SELECT token_id::BIGINT AS token_id, token FROM vocab")
def _(spark, sf):
    return K.stream_vocabulary(_documents(spark, sf))


def _id_sums(df):
    ids = F.col("ids")
    spread = F.aggregate(F.transform(ids, lambda v, i: v.cast("bigint") * (i % 1000 + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return df.select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"),
        F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("id_sum"), spread.alias("placed_sum"),
    )


@query("f02_char_encode", f"""
WITH {_VOCAB}, d AS (SELECT doc_id, unnest(string_split(text, '')) AS token, generate_subscripts(string_split(text, ''), 1) - 1 AS place FROM documents)
SELECT doc_id, count(*)::BIGINT AS n_tokens, sum(token_id)::BIGINT AS id_sum, sum(token_id * (place % 1000 + 1))::BIGINT AS placed_sum
FROM d JOIN vocab USING (token) GROUP BY doc_id""")
def _(spark, sf):
    docs = _documents(spark, sf)
    return _id_sums(K.encode_chars(docs, K.stream_vocabulary(docs)))


@query("f02_char_decode", "SELECT doc_id, sha1(text) AS sha FROM documents")
def _(spark, sf):
    docs = _documents(spark, sf)
    vocab = K.stream_vocabulary(docs)
    return K.decode_tokens(K.encode_chars(docs, vocab).drop("text"), vocab).select("doc_id", F.sha1("decoded").alias("sha"))


@query("f03_pair_counts", f"""
WITH {X.STREAM} SELECT "left", "right", count(*)::BIGINT AS n
FROM (SELECT ch AS "left", lead(ch) OVER (ORDER BY pos) AS "right" FROM chars) WHERE "right" IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    placed = corpus_splits(_documents(spark, sf))
    return K.pair_counts(placed.withColumn("piece", F.col("unit")))


@query("f03_pair_counts_per_document", """
WITH d AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS place FROM documents),
ids AS (SELECT doc_id, place, unicode(ch) AS id FROM d),
p AS (SELECT id AS left_id, lead(id) OVER (PARTITION BY doc_id ORDER BY place) AS right_id FROM ids)
SELECT left_id::BIGINT AS left_id, right_id::BIGINT AS right_id, count(*)::BIGINT AS n FROM p WHERE right_id IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c).cast("bigint"))
    return K.token_pair_counts(_documents(spark, sf).select(ids.alias("ids")))


@query("f04_merge_pair", """
SELECT doc_id, length(replace(text, 'en', '#'))::BIGINT AS n_tokens, (length(text) - length(replace(text, 'en', '')))::BIGINT // 2 AS merged FROM documents""")
def _(spark, sf):
    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    merged = _documents(spark, sf).select("doc_id", merge_column(ord("e"), ord("n"), 0x110000)(ids).alias("ids"))
    return merged.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.size(F.filter("ids", lambda v: v == 0x110000)).cast("bigint").alias("merged"),
    )


def _sql_merges(n: int) -> str:
    """CTEs b0..bn and p1..pn: the stream after each merge, a merged token written as one private-use character."""
    parts = [f"b0 AS MATERIALIZED (SELECT string_agg(text, {X.NL} || {X.NL} ORDER BY doc_id) AS body FROM documents)"]
    for i in range(1, n + 1):
        parts.append(f"""p{i} AS MATERIALIZED (SELECT l, r, count(*) AS freq, min(pos) AS first_at FROM (
  SELECT c AS l, lead(c) OVER (ORDER BY pos) AS r, pos FROM (SELECT unnest(string_split(body, '')) AS c, generate_subscripts(string_split(body, ''), 1) AS pos FROM b{i - 1}))
  WHERE r IS NOT NULL GROUP BY l, r ORDER BY freq DESC, first_at LIMIT 1),
b{i} AS MATERIALIZED (SELECT replace(body, l || r, chr({0xE000 + i})) AS body FROM b{i - 1}, p{i})""")
    return ",\n".join(parts)


def _sql_spelled(column: str, n: int) -> str:
    """A string with the private-use characters of the first n merges written out."""
    for i in range(n, 0, -1):
        column = f"replace({column}, chr({0xE000 + i}), (SELECT l || r FROM p{i}))"
    return column


@query("f05_first_merges", f"""
WITH {_sql_merges(CHECKED)}
{" UNION ALL ".join(f"SELECT {i}::BIGINT AS step, {_sql_spelled('l', i - 1)} AS left, {_sql_spelled('r', i - 1)} AS right, freq::BIGINT AS freq, (SELECT length(body) FROM b{i})::BIGINT AS seq_len FROM p{i}" for i in range(1, CHECKED + 1))}""")
def _(spark, sf):
    log = B.merge_log(spark, _model(spark, sf))
    return log.where(F.col("step") <= CHECKED).select("step", "left", "right", "freq", "seq_len")


@query("f06_first_merges_encode", f"""
WITH {_sql_merges(CHECKED)}
SELECT doc_id, length({"replace(" * CHECKED}text{"".join(f", (SELECT l || r FROM p{i}), chr({0xE000 + i}))" for i in range(1, CHECKED + 1))})::BIGINT AS n_tokens FROM documents""")
def _(spark, sf):
    model = _model(spark, sf)
    first = B.BpeModel(model.base, model.merges[:CHECKED], vocab=model.vocab[: len(model.base) + CHECKED])
    return B.encode_bpe(_documents(spark, sf), first).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"))


@query("f05_bpe_training")
def _(spark, sf):
    return B.merge_log(spark, _model(spark, sf))


@query("f06_bpe_encode", "SELECT doc_id, sha1(text) AS sha, true AS shorter FROM documents")
def _(spark, sf):
    model = _model(spark, sf)
    from textloom.functions.coding import decode_column

    coded = B.encode_bpe(_documents(spark, sf), model)
    return coded.select(
        "doc_id", F.sha1(decode_column(model.vocab)(F.col("ids"))).alias("sha"), (F.size("ids") <= F.length("text")).alias("shorter")
    )


@query("f07_bpe_report")
def _(spark, sf):
    return B.bpe_report(spark, _model(spark, sf))


@query("f07_bpe_longest_fragments")
def _(spark, sf):
    return B.longest_fragments(B.vocabulary_table(spark, _model(spark, sf)))


@query("f08_bpe_monitor")
def _(spark, sf):
    return B.monitor_view(B.merge_log(spark, _model(spark, sf)))


@query("f09_tokenizer_persistence", "SELECT doc_id, sha1(text) AS sha FROM documents")
def _(spark, sf):
    model, path = _model(spark, sf), scratch_path(spark, "tokenizer")
    B.save_tokenizer(spark, path, model.base, model.merges)
    loaded = B.load_tokenizer(spark, path)
    from textloom.functions.coding import decode_column

    coded = B.encode_bpe(_documents(spark, sf), loaded)
    return coded.select("doc_id", F.sha1(decode_column(loaded.vocab)(F.col("ids"))).alias("sha"))


@query("f10_token_splits", f"""
WITH {X.STREAM}, u AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id) - n AS start, n FROM (
    SELECT doc_id, length(text) + CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN 0 ELSE 2 END AS n FROM documents)),
s AS (SELECT * FROM (VALUES ('train'), ('val'), ('test')) v(split), sizes),
b AS (SELECT split, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN total - n_val - n_test ELSE total - n_test END AS f,
      CASE split WHEN 'train' THEN total - n_val - n_test WHEN 'val' THEN total - n_test ELSE total END AS t FROM s)
SELECT split, doc_id, greatest(start, f)::BIGINT AS lo, least(start + n, t)::BIGINT AS hi, sha1(substr(body, greatest(start, f)::BIGINT + 1, (least(start + n, t) - greatest(start, f))::BIGINT)) AS sha
FROM u JOIN b ON greatest(start, f) < least(start + n, t), whole""")
def _(spark, sf):
    return _pieces(spark, sf).select("split", "doc_id", "lo", "hi", F.sha1("piece").alias("sha"))


@query("a06_packed_blocks", f"""
WITH {X.STREAM}, v AS (SELECT count(DISTINCT ch) AS k FROM chars)
SELECT split, ((pos - f) // {BLOCK})::BIGINT AS block_id, count(*)::BIGINT AS n_tokens, sum(unicode(ch))::BIGINT AS code_sum,
  CASE WHEN max(k) > 65535 THEN 'uint32' ELSE 'uint16' END AS token_dtype
FROM (SELECT *, min(pos) OVER (PARTITION BY split) AS f FROM split_chars), v GROUP BY ALL""")
def _(spark, sf):
    from textloom.functions.coding import encode_column
    from textloom.sources.writers import write_token_blocks

    docs = _documents(spark, sf)
    tokens = K.vocabulary_tokens(K.stream_vocabulary(docs))
    pieces = materialize(_pieces(spark, sf), "pieces")
    path = scratch_path(spark, "packed")
    for split in ST.SPLITS:
        part = pieces.where(F.col("split") == split)
        base = part.agg(F.min("lo")).scalar()
        placed = part.select((F.col("lo") - base).alias("start"), F.col("piece").alias("unit"))
        blocks = K.stream_blocks(placed, BLOCK).select(
            F.lit(split).alias("split"), "block_id", encode_column(tokens)(F.col("tokens")).alias("ids")
        )
        write_token_blocks(blocks, f"{path}/{split}", len(tokens))
    codes = F.lit([ord(t) for t in tokens])
    stored = spark.read.parquet(*[f"{path}/{s}/split={s}" for s in ST.SPLITS]).select("*", F.col("_metadata.file_path").alias("file"))
    return stored.select(
        F.regexp_extract("file", "split=([a-z]+)", 1).alias("split"), "block_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, i: a + F.element_at(codes, i + 1)).alias("code_sum"), "token_dtype",
    )


@query("f11_training_windows", f"""
WITH {X.STREAM}, starts AS (SELECT i AS sample_id, ('0x' || left(sha1('windows:' || i), 12))::BIGINT % (total - {BLOCK}) AS start FROM range(0, 500) r(i), sizes)
SELECT sample_id, start, substr(body, start + 1, {BLOCK}) AS x, substr(body, start + 2, {BLOCK}) AS y FROM starts, whole""")
def _(spark, sf):
    placed = corpus_splits(_documents(spark, sf))
    total = placed.agg(F.sum("n")).scalar()
    starts = materialize(K.window_starts(spark, total, 500, BLOCK), "starts")
    return K.training_windows(K.stream_blocks(placed, BLOCK), starts, BLOCK)


@query("f12_round_trip", f"""
WITH {X.STREAM} SELECT split, count(*)::BIGINT AS tokens, true AS lossless FROM split_chars GROUP BY split""")
def _(spark, sf):
    docs = _documents(spark, sf)
    return K.round_trip(_pieces(spark, sf), K.stream_vocabulary(docs)).drop("pieces")


# The subword stream: ids of the whole vocabulary, through split, pack and windows.


def _subwords(spark, sf):
    """Token rows of the stream after all merges, placed."""
    key = (spark.sparkContext.applicationId, sf, "placed")
    if key not in _models:
        _models[key] = materialize(ST.placed_tokens(_model(spark, sf).tokens, "chunk"), "subwords", **B.FEW_ROWS)
    return _models[key]


def _sums(ids, name):
    return F.aggregate(F.transform(ids, lambda v, i: v.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v).alias(name)


def split_sums(placed):
    rows = ST.token_splits(placed).select("split", F.posexplode("ids").alias("i", "id"), "at")
    place = (F.col("at") + F.col("i")) % 1000
    return rows.groupBy("split").agg(F.count("*").alias("tokens"), F.sum("id").cast("bigint").alias("id_sum"), F.sum(F.col("id") * place).cast("bigint").alias("placed_sum"))


def block_sums(spark, placed, vocabulary):
    from textloom.sources.writers import write_token_blocks

    path = scratch_path(spark, "packed-subwords")
    write_token_blocks(ST.token_blocks(ST.token_splits(placed), BLOCK), path, vocabulary)
    blocks = spark.read.parquet(path)
    return blocks.select(F.col("split").cast("string").alias("split"), "block_id", F.size("ids").cast("bigint").alias("n_tokens"), _sums(F.col("ids"), "placed_sum"))


def window_sums(spark, placed):
    starts = materialize(K.window_starts(spark, placed.agg(F.sum("n")).scalar(), 500, BLOCK), "starts")
    windows = ST.token_windows(ST.token_blocks(placed, BLOCK, by=(), at="start"), starts, BLOCK)
    return windows.select("sample_id", "start", _sums(F.col("x"), "x_sum"), _sums(F.col("y"), "y_sum"))


@query("f10_subword_splits")
def _(spark, sf):
    return split_sums(_subwords(spark, sf))


@query("a06_subword_blocks")
def _(spark, sf):
    return block_sums(spark, _subwords(spark, sf), len(_model(spark, sf).vocab))


@query("f11_subword_windows")
def _(spark, sf):
    return window_sums(spark, _subwords(spark, sf))


@query("f13_vocabulary_coverage", """
WITH v AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE lang = 'en'),
l AS (SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY lang, ch)
SELECT 'all' AS live, sum(n)::BIGINT AS chars, coalesce(sum(n) FILTER (ch NOT IN (SELECT ch FROM v)), 0)::BIGINT AS oov_chars,
  count(DISTINCT ch) FILTER (ch NOT IN (SELECT ch FROM v))::BIGINT AS oov_symbols,
  round(1 - coalesce(sum(n) FILTER (ch NOT IN (SELECT ch FROM v)), 0)::DOUBLE / sum(n), 6) AS coverage FROM l""")
def _(spark, sf):
    docs = load(spark, sf, "documents")
    vocab = K.char_vocabulary(docs.where(F.col("lang") == "en"))
    covered = K.coverage(char_counts(docs), vocab)
    return covered.select(F.lit("all").alias("live"), "chars", "oov_chars", "oov_symbols", F.round("coverage", 6).alias("coverage"))
