import datetime as dt

from pyspark.sql import functions as F

from conftest import table
from textloom.operators import drift as D
from textloom.operators import telemetry as K
from textloom.operators.governance import ENTRY_SCHEMA, model_cards, register
from textloom.operators.statistics import char_counts
from textloom.sources.writers import write_cards
from textloom.streaming import serving as STREAM

START = dt.datetime(2026, 1, 1)


def write_parts(df, folder, column, values, name):
    """One file per value, named so that the stream reads them in this order."""
    for i, v in enumerate(values):
        df.where(F.col(column) == v).drop(column).toPandas().to_parquet(f"{folder}/{name}-{i}.parquet", coerce_timestamps="us")


def test_windows_update_over_several_batches(spark, tmp_path):
    rows = [(part, START + dt.timedelta(seconds=37 * i + part), f"/e{i % 2}", 10 * i) for part in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "part int, ts timestamp, endpoint string, tokens bigint")
    write_parts(df, tmp_path, "part", range(3), "requests")
    stream = lambda: STREAM.with_event_time(STREAM.file_stream(spark, str(tmp_path), "requests", df.drop("part").schema, 1))
    for job, keys in ((K.request_rate, ["window_start", "endpoint"]), (K.token_throughput, ["window_start"])):
        live = STREAM.windowed(stream(), job, keys)
        batch = job(df)
        assert sorted(map(str, live.select(*sorted(batch.columns)).collect())) == sorted(map(str, batch.select(*sorted(batch.columns)).collect()))


def test_live_drift_is_cumulative(spark, tmp_path):
    base = D.baseline_counts(table(spark, ["abc abc " * 40]))
    buckets = D.baseline_buckets(base)
    prompts = spark.createDataFrame([(0, "abc"), (0, ""), (1, "xyz"), (1, "abz")], "part int, prompt string")
    write_parts(prompts, tmp_path, "part", range(2), "prompts")
    stream = STREAM.file_stream(spark, str(tmp_path), "prompts", prompts.drop("part").schema, 1)
    reports = STREAM.live_drift(stream, "prompt", buckets, base).orderBy("batch_id").collect()
    assert [r["requests"] for r in reports] == [2, 4] and [r["chars_seen"] for r in reports] == [3, 9]
    whole = D.drift_report(F.lit(4), buckets, base, char_counts(prompts, "prompt")).first()
    assert reports[-1]["psi"] == whole["psi"] and reports[-1]["oov_rate"] == whole["oov_rate"] == round(4 / 9, 4)
    assert reports[0]["psi"] < reports[-1]["psi"]


def test_cards_are_written_per_model(spark, tmp_path):
    ledger = spark.createDataFrame(
        [("sha256:ab", "ab", "production", "t", (64, 2, 4, 32, 0.1, True, 90, True, False, True, None, False), 1.5, (None, 3.5, 33.1), ("sha256:d", 8, 90, 1000, "char", True, "c1"))],
        ENTRY_SCHEMA)
    write_cards(model_cards(ledger), str(tmp_path / "cards"))
    body = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "cards" / "short=ab")).collect())
    assert "| Status | **production** |" in body and "test_loss=3.5" in body and "gate: passed" in body
    assert "n_layer=2, n_head=4, n_kv_head=None" in body and "| Parameters | 1.5 M |" in body and "## Limits" in body


def test_first_entry_of_a_digest_wins(spark):
    row = lambda digest, created, loss: (digest, digest[-2:], "registered", created, None, 1.0, (None, loss, None), None)
    ledger = spark.createDataFrame([row("sha256:aa", "t5", 1.0)], ENTRY_SCHEMA)
    entries = spark.createDataFrame([row("sha256:bb", "t9", 3.0), row("sha256:bb", "t2", 2.0), row("sha256:aa", "t1", 9.0)], ENTRY_SCHEMA)
    got = {r["model_digest"]: r["metrics"]["test_loss"] for r in register(ledger, entries).collect()}
    assert got == {"sha256:aa": 1.0, "sha256:bb": 2.0}


def test_restarted_streams_resume(spark, tmp_path):
    rows = [(part, START + dt.timedelta(seconds=60 * (i % 2) + part), "chat", 0.1 * i + part) for part in range(2) for i in range(6)]
    df = spark.createDataFrame(rows, "part int, ts timestamp, endpoint string, latency double")
    source = tmp_path / "in"
    source.mkdir()

    def run(job, name):
        stream = STREAM.file_stream(spark, str(source), "requests", df.drop("part").schema, 1)
        timed = STREAM.with_event_time(stream, lateness=None)
        return STREAM.windowed(timed, job, ["window_start", "endpoint"], folder=str(tmp_path / name))

    histogram = lambda s: K.windowed_histogram(s, ["endpoint"])
    for part in range(2):  # the second run is a restart: it must neither forget nor count twice
        df.where(F.col("part") == part).drop("part").toPandas().to_parquet(f"{source}/requests-{part}.parquet", coerce_timestamps="us")
        assert [r["requests"] for r in run(K.request_rate, "rate").collect()] == [3 * (part + 1)] * 2
        live = K.windowed_quantile(run(histogram, "quantile"), 0.95, ["endpoint"])
        whole = K.windowed_quantile(histogram(df.where(F.col("part") <= part)), 0.95, ["endpoint"])
        assert sorted(map(str, live.collect())) == sorted(map(str, whole.collect()))


def test_tables_in_folders_are_streamed(spark, tmp_path):
    prompts = spark.createDataFrame([(0, "abc"), (1, "xyz")], "part int, prompt string")
    folder = tmp_path / "prompts.parquet"
    folder.mkdir()
    write_parts(prompts, folder, "part", range(2), "part")
    stream = STREAM.file_stream(spark, str(tmp_path), "prompts", prompts.drop("part").schema, 1)
    assert stream.isStreaming
    base = D.baseline_counts(table(spark, ["abc abc " * 40]))
    reports = STREAM.live_drift(stream, "prompt", D.baseline_buckets(base), base).orderBy("requests").collect()
    assert [r["requests"] for r in reports] == [1, 2]


def test_predictions_are_never_broadcast(spark, tmp_path):
    from textloom.catalog.serving import predictions

    turns = [(c, t, "user" if t == 0 else "assistant", "abababab" if t == 0 else "abcd" * (c + 1)) for c in range(3) for t in range(2)]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").toPandas().to_parquet(f"{tmp_path}/conversations.parquet")
    rows = predictions(spark, str(tmp_path))
    assert "BuildLeft" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, rows.where("request_id = 1").select("model", "pos", "pred").collect()))
    assert got == [("candidate", n, p) for n, p in enumerate("bcda")] + [("production", n, p) for n, p in enumerate("bada")]
    agreed = {r["request_id"]: (r["positions"], r["agreement"]) for r in K.shadow_agreement(rows).collect()}
    assert agreed == {1: (4, 0.75), 1001: (8, 0.75), 2001: (12, 0.75)}
