"""Training-corpus pipeline: the stages that turn raw documents into packed tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bpe_codec import round_trip
from textloom.llm.common import read, stored
from textloom.llm.decontaminate import overlaps
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.near_texts import near_duplicates
from textloom.llm.quality import classify
from textloom.llm.queries import byte_bpe


BROADCAST_IDS = 2_000_000


def _drop(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among gone; null is an id like others, rows of one id go together.

    Ids are counted first: up to BROADCAST_IDS are broadcast, and the texts do
    not move; more are joined by a shuffle.
    """
    gone = stored(gone.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    small = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(small, docs["doc_id"].eqNullSafe(small["_gone"]), "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores as good; those it rejects go."""
    return _drop(docs, classify(docs, read(spark, sf_dir, "labels")).where("predicted = 0"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the largest doc_id; of a repeated row, one."""
    rows = exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    odd = stored(rows.where("n > 1 OR NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "odd")
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)

    def among(keys: DataFrame, how: str) -> DataFrame:
        small = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
        return docs.join(small, docs["doc_id"].eqNullSafe(small["_id"]) & (digest == small["_sha"]), how)

    out = among(odd.drop("kept"), "left_anti")
    repeated = odd.where("kept").drop("kept")
    if repeated.isEmpty():
        return out
    return out.unionByName(among(repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return _drop(docs, near_duplicates(docs).where("NOT doc_id <=> component_id"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return _drop(docs, overlaps(docs, read(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return round_trip(docs, *byte_bpe())


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", distinct_texts),
    ("near_dedup", near_distinct),
    ("decontaminate", clean_of_benchmark),
    ("byte_bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
