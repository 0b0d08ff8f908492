from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import load, query
from textloom.catalog import fragments as X
from textloom.operators.ordinals import take_until_budget
from textloom.plans import corpus as P
from textloom.session import scratch_path
from textloom.sources import readers as R
from textloom.sources import writers as W

SEP = "<|doc|>"


def _documents(spark, sf):
    return load(spark, sf, "documents")


@query("a01_folder_scan", """
SELECT count(DISTINCT source)::BIGINT AS files, sum(length(text) + 1)::BIGINT AS n_chars, sum(octet_length(encode(text)) + 1)::BIGINT AS n_bytes,
  true AS dense FROM documents""")
def _(spark, sf):
    path = scratch_path(spark, "folder")
    docs = _documents(spark, sf)
    docs.select("source", "text").repartition("source").write.partitionBy("source").text(path)
    scanned = R.read_folder(spark, path)
    return scanned.agg(
        F.count("*").alias("files"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.octet_length("text").cast("bigint")).alias("n_bytes"),
        (F.max("doc_id") == F.count("*") - 1).alias("dense"),
    )


@query("a02_delimited_scan", "SELECT sha1(text) AS sha, length(text)::BIGINT AS n_chars, count(*)::BIGINT AS copies FROM documents WHERE text <> '' GROUP BY 1, 2")
def _(spark, sf):
    path = scratch_path(spark, "delimited")
    _documents(spark, sf).select("text").write.option("lineSep", SEP).text(path)
    docs = R.read_delimited(spark, path, SEP).where(F.col("text") != "")
    return docs.groupBy(F.sha1("text").alias("sha"), F.length("text").cast("bigint").alias("n_chars")).agg(F.count("*").alias("copies"))


@query("a03_budgeted_ingest", """
WITH t AS (SELECT doc_id, octet_length(encode(text)) AS b FROM documents),
p AS (SELECT doc_id, sum(b) OVER (ORDER BY doc_id) - b AS bytes_before, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM t)
SELECT doc_id, ordinal::BIGINT AS ordinal, bytes_before::BIGINT AS bytes_before FROM p WHERE bytes_before < 1500000 AND ordinal < 800""")
def _(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "text")
    return take_until_budget(docs, "doc_id", "text", 1_500_000, 800).drop("text")


@query("a04_pair_jsonl", f"WITH {X.EXCHANGES} SELECT prompt AS q, response AS a FROM exchanges")
def _(spark, sf):
    path = scratch_path(spark, "pairs")
    W.write_pairs(X.exchanges(load(spark, sf, "conversations")).select(F.col("prompt").alias("q"), F.col("response").alias("a")), path)
    return R.read_pairs(spark, path)


@query("a04_preference_jsonl", f"WITH {X.EXCHANGES} SELECT prompt, response AS chosen, repeat(left(response, 2), 3) AS rejected FROM exchanges")
def _(spark, sf):
    path = scratch_path(spark, "preferences")
    pairs = X.exchanges(load(spark, sf, "conversations"))
    W.write_pairs(pairs.select("prompt", F.col("response").alias("chosen"), F.repeat(F.left("response", F.lit(2)), F.lit(3)).alias("rejected")), path)
    return R.read_preferences(spark, path)


@query("a05_run_log_csv", f"""
WITH {X.RUN_LOG} SELECT run, step::BIGINT AS step, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss FROM run_log""")
def _(spark, sf):
    path = scratch_path(spark, "runs")
    W.write_run_log(X.run_log(load(spark, sf, "events")).select("run", "step", "train_loss", "val_loss"), path)
    log = R.read_run_logs(spark, path)
    return log.select("run", F.col("step").cast("bigint").alias("step"), F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"))


@query("a07_stage_report", f"""
WITH {X.JUDGED_MESSY}, g AS (SELECT * FROM judged WHERE reason = 'ok'),
n AS (SELECT (SELECT count(*) FROM judged) AS a, (SELECT count(*) FROM g) AS b, (SELECT count(DISTINCT sha1({X.sql_collapse('text')})) FROM g) AS c)
SELECT stage, i::BIGINT AS n_in, o::BIGINT AS n_out, (i - o)::BIGINT AS dropped,
  CASE WHEN stage = 'quality' THEN (SELECT count(*) FROM judged WHERE reason = 'too_short') END::BIGINT AS too_short,
  CASE WHEN stage = 'quality' THEN (SELECT count(*) FROM judged WHERE reason = 'too_repetitive') END::BIGINT AS too_repetitive,
  CASE WHEN stage = 'near_dedup' THEN 0.6::DOUBLE END AS threshold
FROM (SELECT 'quality' AS stage, a AS i, b AS o FROM n UNION ALL SELECT 'exact_dedup', b, c FROM n UNION ALL SELECT 'near_dedup', c, c FROM n)""")
def _(spark, sf):
    path = scratch_path(spark, "report")
    report = P.stage_report(P.prepare_corpus(X.messy(_documents(spark, sf)), near=False))
    W.write_report(report, path)
    stored = spark.read.schema(report.schema).json(path)
    return stored.select(
        "stage", "n_in", "n_out", "dropped", F.col("reasons")["too_short"].alias("too_short"),
        F.col("reasons")["too_repetitive"].alias("too_repetitive"), "threshold",
    )


@query("a08_artifact_digest", """
SELECT doc_id // 25 AS part, sum(octet_length(encode(text)) + 1)::BIGINT AS n_bytes, sha256(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS digest
FROM documents GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "artifacts")
    part = F.floor(F.col("doc_id") / 25).alias("part")  # files of 25 documents
    rows = _documents(spark, sf).select(part, "doc_id", "text").repartition("part").sortWithinPartitions("part", "doc_id")
    rows.select("part", "text").write.partitionBy("part").text(path)
    return R.file_digests(spark, path).select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("bigint").alias("part"), "n_bytes", "digest")


@query("a09_request_log", f"""
WITH {X.REQUESTS} SELECT variant, count(*)::BIGINT AS requests, sum(tokens)::BIGINT AS tokens, round(sum(latency * 1000), 3) AS latency_ms
FROM requests GROUP BY variant""")
def _(spark, sf):
    from textloom.streaming.serving import latest, run_updates

    path = scratch_path(spark, "request-log")
    X.requests(load(spark, sf, "events")).select(
        (F.unix_micros("ts") / 1e6).alias("ts"), F.lit("generate").alias("event"), "variant", F.lit(8).alias("prompt_len"),
        F.col("tokens").cast("int").alias("tokens"), (F.col("latency") * 1000).alias("latency_ms"), F.lit(True).alias("kv_cache"),
    ).write.json(path)
    totals = R.stream_request_log(spark, path).groupBy("variant").agg(
        F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("latency_ms").alias("latency_ms")
    )
    return latest(run_updates(totals), ["variant"]).withColumn("latency_ms", F.round("latency_ms", 3))


@query("a10_merged_text", """
WITH m AS (SELECT string_split(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), chr(10)) AS parts FROM documents)
SELECT i::BIGINT AS line, sha1(parts[i + 1]) AS sha FROM m, (SELECT unnest(range(0, len(parts))) AS i FROM m)""")
def _(spark, sf):
    path = scratch_path(spark, "merged")
    W.write_merged_text(_documents(spark, sf), path)
    return R.read_lines(spark, path).select(F.col("ordinal").alias("line"), F.sha1("text").alias("sha"))
