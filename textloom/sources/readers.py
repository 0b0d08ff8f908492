"""Scans.  Every table gets an explicit schema and, where order matters, a sort key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.ordinals import with_ordinal
from textloom.session import materialize, spread

PAIR_SCHEMA = "q string, a string"
PREFERENCE_SCHEMA = "prompt string, chosen string, rejected string"
RUN_LOG_SCHEMA = "step int, train_loss double, val_loss double"
REQUEST_LOG_SCHEMA = (
    "ts double, event string, variant string, prompt_len int, tokens int, latency_ms double, kv_cache boolean"
)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, with enough tasks for per-row text work."""
    return spread(spark.read.parquet(path))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.txt`` below ``path`` as one document, numbered in path order."""
    raw = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
        .select(F.col("path").alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    )
    return with_ordinal(materialize(raw, "folder"), "source", "doc_id").select("doc_id", "text", "source")


def read_delimited(spark: SparkSession, path: str, doc_sep: str | None = None) -> DataFrame:
    """File(s) cut at ``doc_sep`` into numbered documents; no separator, one document each.

    The splittable text reader cuts at the separator.  It yields no row after a
    trailing separator, where cutting a string would give one empty document,
    so that one is added back per file.
    """
    if not doc_sep:
        raw = spark.read.text(path, wholetext=True).select(F.make_valid_utf8("value").alias("text"), F.lit(0).cast("bigint").alias("n_bytes"), _place(F.col("_metadata.file_path"), F.lit(0), F.lit(0)).alias("place"))
    else:
        # File, offset of the split and row inside it: the order of the documents.
        raw = spark.read.option("lineSep", doc_sep).text(path).select(
            F.make_valid_utf8("value").alias("text"), F.octet_length("value").cast("bigint").alias("n_bytes"),
            _place(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
        )
        raw = materialize(raw, "delimited")
        raw = raw.unionByName(_trailing_documents(spark, path, raw, doc_sep))
    placed = with_ordinal(materialize(raw, "delimited"), "place", "doc_id")
    source = F.concat(F.substring_index("place", "|", 1), F.lit("#"), F.col("doc_id").cast("string"))
    return placed.select("doc_id", "text", source.alias("source"))


def _place(file: Column, offset: Column, row: Column) -> Column:
    # Readers and listings write local URIs with one or three slashes.
    name = F.regexp_replace(file, "^file:/+", "file:/")
    return F.concat_ws("|", name, F.lpad(offset.cast("string"), 20, "0"), F.lpad(row.cast("string"), 20, "0"))


def _trailing_documents(spark: SparkSession, path: str, rows: DataFrame, doc_sep: str) -> DataFrame:
    """One empty document, placed last, per file that is empty or ends with the separator.

    Such a file is as long as its rows with a separator after every one, the
    last included; no file is opened for its size.  Scans leave out files
    without a byte, so their names come from the driver's listing.
    """
    name = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    sizes = spark.read.format("binaryFile").load(path).select(name(F.col("path")).alias("file"), "length")
    filled = rows.groupBy(F.substring_index("place", "|", 1).alias("file")).agg(F.sum(F.col("n_bytes") + len(doc_sep.encode("utf-8"))).alias("filled"))
    full = sizes.join(filled, "file").where(F.col("length") == F.col("filled")).select("file")
    empty = spark.createDataFrame([(f,) for f in _empty_files(spark, path)], "file string").select(name(F.col("file")).alias("file"))
    ends = full.unionByName(empty)
    return ends.select(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_bytes"), _place(F.col("file"), F.lit(1 << 62), F.lit(0)).alias("place"))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    files = [e.getPath() for e in found if e.isFile() and e.getLen() == 0]
    return [p.toUri().toString() for p in files if not p.getName().startswith(("_", "."))]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, text): the lines of the part files below ``path``, in the order of names and places."""
    raw = spark.read.text(path).select(
        F.col("value").alias("text"), _place(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place")
    )
    return with_ordinal(materialize(raw, "lines"), "place").select("ordinal", "text")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR_SCHEMA).json(path)


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREFERENCE_SCHEMA).json(path)


def read_run_logs(spark: SparkSession, path: str, schema: str = RUN_LOG_SCHEMA) -> DataFrame:
    """CSV logs; the run is named by its folder (``run=name``) or else by the file stem."""
    file = F.col("_metadata.file_path")
    folder, stem = F.regexp_extract(file, "/run=([^/]+)/", 1), F.regexp_extract(file, r"([^/]+)\.csv$", 1)
    logs = spark.read.schema(schema).option("header", "true").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").csv(path)
    return logs.select(F.coalesce(F.nullif(folder, F.lit("")), stem).alias("run"), "*")


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST_LOG_SCHEMA).json(path)


def stream_request_log(spark: SparkSession, path: str) -> DataFrame:
    """The request log as a stream, with an event-time column."""
    return spark.readStream.schema(REQUEST_LOG_SCHEMA).json(path).withColumn("event_time", F.timestamp_seconds("ts"))


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of the bytes of every file, with the 12-character short form."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    digest = F.sha2("content", 256)
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("n_bytes"),
        digest.alias("digest"), F.substring(digest, 1, 12).alias("short"),
    )
