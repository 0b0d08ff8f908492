from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog import load, query
from textloom.catalog import fragments as X
from textloom.catalog.drifting import PSI_SQL, REPORT_SQL, _baseline
from textloom.catalog.governing import GATE_SQL, _ledger
from textloom.operators import drift as D
from textloom.operators import telemetry as K
from textloom.operators.statistics import char_counts
from textloom.session import materialize
from textloom.streaming import serving as STREAM

_MINUTE = "date_trunc('minute', ts)"
TASK_REQUESTS = 20_000


def _requests(spark, sf):
    return X.requests(load(spark, sf, "events"))


def _stream(spark, sf):
    schema = load(spark, sf, "events").schema
    return X.requests(STREAM.with_event_time(STREAM.file_stream(spark, sf, "events", schema)))


def _minutes(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


_WINDOW = f"strftime({_MINUTE}, '%Y-%m-%d %H:%M:%S') AS window_start"
_RATE = f"WITH {X.REQUESTS} SELECT {_WINDOW}, endpoint, count(*)::BIGINT AS requests, round(count(*) / 60.0::DOUBLE, 6) AS rate FROM requests GROUP BY ALL"
_VARIANTS = f"WITH {X.REQUESTS} SELECT {_WINDOW}, variant, count(*)::BIGINT AS requests FROM requests GROUP BY ALL"
_TOKENS = f"WITH {X.REQUESTS} SELECT {_WINDOW}, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / 60.0::DOUBLE, 6) AS tokens_per_second FROM requests GROUP BY ALL"


@query("k01_request_totals", f"WITH {X.REQUESTS} SELECT endpoint, status::BIGINT AS status, count(*)::BIGINT AS requests FROM requests GROUP BY ALL")
def _(spark, sf):
    return K.request_totals(_requests(spark, sf))


@query("k01_request_rate", _RATE)
def _(spark, sf):
    return _minutes(K.request_rate(_requests(spark, sf))).withColumn("rate", F.round("rate", 6))


@query("k01_request_rate_stream", _RATE)
def _(spark, sf):
    rates = STREAM.windowed(_stream(spark, sf), K.request_rate, ["window_start", "endpoint"])
    return _minutes(rates).withColumn("rate", F.round("rate", 6))


def _index(p: int) -> str:
    return f"list_sort(list(latency))[least(count(*) - 1, floor({p} / 100.0::DOUBLE * count(*)))::BIGINT + 1]"


@query("k02_latency_percentiles", f"""
WITH {X.REQUESTS} SELECT endpoint, count(*)::BIGINT AS count, round({_index(50)}, 6) AS p50, round({_index(95)}, 6) AS p95 FROM requests GROUP BY endpoint""")
def _(spark, sf):
    return K.latency_percentiles(_requests(spark, sf), ["endpoint"]).select("endpoint", "count", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


_BUCKETS = f"""h AS (SELECT endpoint, le, count(*) FILTER (latency <= le) AS c
  FROM requests, (SELECT unnest([{', '.join(map(str, K.LATENCY_BORDERS))}, 'inf'::DOUBLE]) AS le) GROUP BY ALL)"""


@query("k03_histogram_quantile", f"""
WITH {X.REQUESTS}, {_BUCKETS},
p AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS below, max(c) OVER (PARTITION BY endpoint) * 0.95::DOUBLE AS target
  FROM h WINDOW w AS (PARTITION BY endpoint ORDER BY le))
SELECT endpoint, round(arg_min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (target - below) / (c - below) END, le), 6) AS quantile
FROM p WHERE c >= target GROUP BY endpoint""")
def _(spark, sf):
    histogram = K.bucket_counts(_requests(spark, sf), "latency", K.LATENCY_BORDERS, ["endpoint"])
    return K.histogram_quantile(histogram, 0.95, ["endpoint"]).withColumn("quantile", F.round("quantile", 6))


@query("k04_token_throughput", _TOKENS)
def _(spark, sf):
    return _minutes(K.token_throughput(_requests(spark, sf))).withColumn("tokens_per_second", F.round("tokens_per_second", 6))


@query("k04_token_throughput_stream", _TOKENS)
def _(spark, sf):
    rows = STREAM.windowed(_stream(spark, sf), K.token_throughput, ["window_start"])
    return _minutes(rows).withColumn("tokens_per_second", F.round("tokens_per_second", 6))


@query("k04_running_tokens", f"""
WITH {X.REQUESTS}, m AS (SELECT {_MINUTE} AS w, sum(tokens) AS tokens FROM requests GROUP BY 1)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, tokens::BIGINT AS tokens, (sum(tokens) OVER (ORDER BY w))::BIGINT AS total_tokens FROM m""")
def _(spark, sf):
    throughput = materialize(K.token_throughput(_requests(spark, sf)), "throughput")
    return _minutes(K.running_tokens(throughput)).drop("tokens_per_second")


@query("k05_variant_traffic", _VARIANTS)
def _(spark, sf):
    return _minutes(K.variant_traffic(_requests(spark, sf)))


@query("k05_variant_traffic_stream", _VARIANTS)
def _(spark, sf):
    return _minutes(STREAM.windowed(_stream(spark, sf), K.variant_traffic, ["window_start", "variant"]))


@query("k06_variant_latency", f"WITH {X.REQUESTS} SELECT variant, round({_index(95)}, 6) AS p95 FROM requests GROUP BY variant")
def _(spark, sf):
    return K.latency_percentiles(_requests(spark, sf), ["variant"]).select("variant", F.round("p95", 6).alias("p95"))


@query("k06_variant_latency_stream", f"""
WITH {X.REQUESTS}, w AS (SELECT {_WINDOW}, variant, latency FROM requests),
b AS (SELECT window_start, variant, le, count(*) FILTER (latency <= le) AS c FROM w, (SELECT unnest([{', '.join(map(str, K.LATENCY_BORDERS))}, 'inf'::DOUBLE]) AS le) GROUP BY ALL),
p AS (SELECT *, coalesce(lag(le) OVER o, 0.0) AS lower, coalesce(lag(c) OVER o, 0) AS below, max(c) OVER (PARTITION BY window_start, variant) * 0.95 AS target
  FROM b WINDOW o AS (PARTITION BY window_start, variant ORDER BY le)),
h AS (SELECT *, CASE WHEN isinf(le) THEN lower ELSE lower + (le - lower) * (target - below) / (c - below) END AS q FROM p WHERE c >= target AND target > 0)
SELECT window_start, variant, round(min_by(q, le), 6) AS p95 FROM h GROUP BY ALL""")
def _(spark, sf):
    histograms = STREAM.windowed(_stream(spark, sf), K.windowed_histogram, ["window_start", "variant"])
    return _minutes(K.windowed_quantile(histograms, 0.95)).select("window_start", "variant", F.round("quantile", 6).alias("p95"))


@query("k07_average_batch", f"""
WITH {X.REQUESTS} SELECT {_WINDOW}, sum(batch_size)::BIGINT AS size_sum, count(*)::BIGINT AS batches, round(avg(batch_size), 6) AS avg_batch FROM requests GROUP BY ALL
UNION ALL SELECT 'lifetime', sum(batch_size)::BIGINT, count(*)::BIGINT, round(avg(batch_size), 6) FROM requests""")
def _(spark, sf):
    rows = _requests(spark, sf)
    by_minute = F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm:ss").alias("window_start")
    lifetime = K.average_batch(rows).withColumn("window_start", F.lit("lifetime"))
    return K.average_batch(rows, [by_minute]).unionByName(lifetime).withColumn("avg_batch", F.round("avg_batch", 6))


# Predictions: after each character of an exchange, the most frequent follower
# in all turns (production) and in assistant turns only (candidate).
def predictions(spark, sf):
    turns = load(spark, sf, "conversations")

    def followers(rows):
        grams = rows.select(F.explode(F.regexp_extract_all("text", F.lit("(?s)(?=(..))"), F.lit(1))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
        best = F.min_by(F.right("g", F.lit(1)), F.struct(-F.col("n"), F.right("g", F.lit(1))))
        return grams.groupBy(F.left("g", F.lit(1)).alias("prev")).agg(best.alias("pred"))

    # Spark takes the positions for as small as the texts that they come from: the tables are broadcast, one row per character.
    best = followers(turns).withColumnRenamed("pred", "production")
    other = followers(turns.where(F.col("role") == "assistant")).withColumnRenamed("pred", "candidate")
    # All positions of a request are made in one task, and compared there.
    asked = X.exchanges(turns)
    tasks = max(2 * spark.sparkContext.defaultParallelism, asked.count() // TASK_REQUESTS)
    positions = asked.repartition(tasks, "pair_id").select("pair_id", F.posexplode(F.split("response", "")).alias("pos", "prev"))
    both = positions.join(F.broadcast(best), "prev", "left").join(F.broadcast(other), "prev", "left")
    known = F.filter(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in ("production", "candidate")]), lambda m: m["pred"].isNotNull())
    return both.select(F.col("pair_id").alias("request_id"), "pos", F.inline(known))


def _sql_followers(where: str) -> str:
    return f"""(SELECT prev, arg_min(nxt, (-n, nxt)) AS pred FROM (SELECT c AS prev, d AS nxt, count(*) AS n FROM (
      SELECT unnest(string_split(text, '')) AS c, unnest(string_split(substr(text, 2), '')) AS d FROM conversations WHERE {where})
      WHERE d IS NOT NULL AND d <> '' GROUP BY ALL) GROUP BY prev)"""


PREDICTIONS = f"""{X.EXCHANGES},
positions AS MATERIALIZED (SELECT pair_id, unnest(string_split(response, '')) AS prev, generate_subscripts(string_split(response, ''), 1) - 1 AS pos FROM exchanges),
agreements AS (SELECT pair_id AS request_id, count(*)::BIGINT AS positions, avg((a.pred = b.pred)::INT) AS agreement
  FROM positions JOIN {_sql_followers('true')} a USING (prev) JOIN {_sql_followers("role = 'assistant'")} b USING (prev) GROUP BY pair_id)"""


@query("k08_shadow_agreement", f"WITH {PREDICTIONS} SELECT request_id, positions, round(agreement, 6) AS agreement FROM agreements")
def _(spark, sf):
    return K.shadow_agreement(predictions(spark, sf)).withColumn("agreement", F.round("agreement", 6))


@query("k08_agreement_histogram", f"""
WITH {PREDICTIONS} SELECT le, count(*) FILTER (agreement <= le)::BIGINT AS cumulative_count
FROM agreements, (SELECT unnest([{', '.join(map(str, K.AGREEMENT_BORDERS))}, 'inf'::DOUBLE]) AS le) GROUP BY le""")
def _(spark, sf):
    return K.bucket_counts(K.shadow_agreement(predictions(spark, sf)), "agreement", K.AGREEMENT_BORDERS)


@query("k08_agreement_window", f"""
WITH {X.REQUESTS}, {PREDICTIONS} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*)::BIGINT AS compared, round(avg(agreement), 6) AS agreement
FROM agreements JOIN requests ON event_id = request_id GROUP BY 1""")
def _(spark, sf):
    rows = K.agreement_by_window(K.shadow_agreement(predictions(spark, sf)), _requests(spark, sf), width="1 hour")
    return _minutes(rows).withColumn("agreement", F.round("agreement", 6))


@query("k09_cold_start", f"""
WITH {X.REQUESTS}, o AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts, event_id) AS k FROM requests),
w AS (SELECT endpoint, {_index(50)} AS p50, {_index(95)} AS p95 FROM o WHERE k > 1 GROUP BY endpoint)
SELECT endpoint, round(latency, 6) AS cold, round(p50, 6) AS p50, round(p95, 6) AS p95, round(latency / p50, 6) AS ratio FROM o JOIN w USING (endpoint) WHERE k = 1""")
def _(spark, sf):
    report = K.cold_start(_requests(spark, sf), by=["endpoint"])
    return report.select("endpoint", *[F.round(c, 6).alias(c) for c in ("cold", "p50", "p95", "ratio")])


@query("k10_canary_routing", f"WITH {X.REQUESTS} SELECT event_id, variant, shadowed FROM requests")
def _(spark, sf):
    return _requests(spark, sf).select("event_id", "variant", "shadowed")


@query("k11_live_drift_stream", REPORT_SQL)
def _(spark, sf):
    base = _baseline(spark, sf)
    schema = load(spark, sf, "conversations").schema
    prompts = STREAM.file_stream(spark, sf, "conversations", schema)
    reports = STREAM.live_drift(prompts, "text", D.baseline_buckets(base), base)
    last = reports.agg(F.max("requests")).scalar()
    return reports.where(F.col("requests") == last).drop("batch_id").distinct()


@query("k12_rollout_decision", f"""
WITH {X.REQUESTS}, {PREDICTIONS}, v AS (SELECT variant, {_index(95)} AS p95 FROM requests GROUP BY variant),
g AS ({GATE_SQL}), d AS ({PSI_SQL}), a AS (SELECT avg(agreement) AS agreement FROM agreements)
SELECT short, CASE WHEN reasons = '' THEN 'release' ELSE 'hold' END AS decision, reasons,
  concat_ws('; ', CASE WHEN agreement < 0.9 THEN 'behaviour changed, review outputs' END,
    CASE WHEN (SELECT p95 FROM v WHERE variant = 'canary') > (SELECT p95 FROM v WHERE variant = 'production') THEN 'canary slower' END,
    CASE WHEN (SELECT psi FROM d) >= 0.25 THEN 'input drift' END) AS advice FROM g, a""")
def _(spark, sf):
    from textloom.operators.governance import with_gate

    p95 = materialize(K.latency_percentiles(_requests(spark, sf), ["variant"]), "p95")
    agreement = K.shadow_agreement(predictions(spark, sf)).agg(F.avg("agreement")).scalar()
    base = _baseline(spark, sf)
    psi = D.character_psi(D.baseline_buckets(base), char_counts(load(spark, sf, "conversations"))).scalar()
    candidates = with_gate(_ledger(spark, sf)).select(
        "short", "reasons", agreement.alias("agreement"), p95.where(F.col("variant") == "canary").select("p95").scalar().alias("canary_p95"),
        p95.where(F.col("variant") == "production").select("p95").scalar().alias("production_p95"), psi.alias("psi"),
    )
    return K.rollout_decision(candidates).select("short", "decision", F.concat_ws("; ", "reasons").alias("reasons"), F.concat_ws("; ", "advice").alias("advice"))
