"""Structured Streaming jobs over the request stream.

Each job runs the batch functions of ``operators.telemetry`` on a stream and
keeps its result in a table of the shared folder: one folder per micro-batch,
so a batch that is run again overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from textloom.operators import drift as D
from textloom.session import materialize, scratch_path

LATENESS = "10 minutes"


def file_stream(spark: SparkSession, folder: str, table: str, schema: S.StructType, files_per_batch: int = 1000) -> DataFrame:
    """The Parquet files of a table in a growing folder as a stream, or those in its folders; a backlog is read in bounded batches."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder.rstrip('/')}/{table}*.parquet")


def with_event_time(stream: DataFrame, ts: str = "ts", lateness: str | None = LATENESS) -> DataFrame:
    """Watermarks need a zoned timestamp.  Without ``lateness`` no row is ever too late, and state is kept for good."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, lateness) if lateness else timed


def _folders(spark: SparkSession, folder: str | None) -> tuple[str, str]:
    """Where a job keeps results and state: the caller's folder, so that a restart resumes, or a new one."""
    folder = (folder or scratch_path(spark, "stream")).rstrip("/")
    return f"{folder}/out", f"{folder}/state"


def run_updates(result: DataFrame, mode: str = "update", folder: str | None = None) -> DataFrame:
    """Run the stream over everything available; returns all emitted rows with ``batch_id``.

    With the same ``folder`` a later run reads only what has come since.
    """
    spark = result.sparkSession
    out, state = _folders(spark, folder)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        result.writeStream.outputMode(mode).option("checkpointLocation", state)
        .trigger(availableNow=True).foreachBatch(store).start()
    )
    query.awaitTermination()
    schema = S.StructType([*result.schema.fields, S.StructField("batch_id", S.LongType())])
    return spark.read.schema(schema).parquet(out)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest version of every updated row."""
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values])


def windowed(stream: DataFrame, job: Callable[[DataFrame], DataFrame], keys: Sequence[str], folder: str | None = None) -> DataFrame:
    """Run a windowed telemetry function on a stream to completion."""
    return latest(run_updates(job(stream), folder=folder), keys)


def live_drift(prompts: DataFrame, text: str, buckets: DataFrame, vocab: DataFrame, folder: str | None = None) -> DataFrame:
    """Cumulative character counts of all requests, reported after every micro-batch.

    State is one row per distinct character.  The request counter rides along
    as a row of its own.  With the same ``folder`` a later run goes on counting.
    """
    spark = prompts.sparkSession
    out, state = _folders(spark, folder)
    buckets, vocab = materialize(buckets, "buckets"), materialize(vocab, "vocab")
    request = F.lit("")  # the counter of requests; no character is empty
    symbols = F.concat(F.array(request), F.filter(F.split(F.col(text), ""), lambda c: c != ""))
    counts = prompts.select(F.explode(symbols).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))

    def report(batch: DataFrame, batch_id: int) -> None:
        seen = materialize(batch, "live-counts")
        requests = seen.where(F.col("ch") == "").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
        D.drift_report(requests, buckets, vocab, seen.where(F.col("ch") != "")).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        counts.writeStream.outputMode("complete").option("checkpointLocation", state)
        .trigger(availableNow=True).foreachBatch(report).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)
