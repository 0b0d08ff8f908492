"""One registered query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.bpe_codec import read_ranks, round_trip
from textloom.llm import licenses
from textloom.llm import secret_scan
from textloom.llm.common import read
from textloom.llm.decontaminate import overlaps
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.language import identify
from textloom.llm.pages import extract
from textloom.llm.passages import repeated_passages
from textloom.llm.pii import personal_data
from textloom.llm.quality import classify
from textloom.llm.simhash import simhash_dedup
from textloom.llm.variants import spelling_variants
from textloom.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def byte_bpe() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@query("op1_simhash")
def _(spark, sf):
    return simhash_dedup(read(spark, sf, "documents"))


@query("op2_licenses", licenses.oracle_sql())
def _(spark, sf):
    return licenses.recognise(read(spark, sf, "documents"))


@query("op3_quality")
def _(spark, sf):
    return classify(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("op4_decontaminate")
def _(spark, sf):
    return overlaps(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("op5_secrets", secret_scan.oracle_sql())
def _(spark, sf):
    return secret_scan.secrets(read(spark, sf, "documents"))


@query("op6_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def _(spark, sf):
    return exact_dedup(read(spark, sf, "documents"))


@query("op7_language")
def _(spark, sf):
    return identify(read(spark, sf, "documents"))


@query("op8_byte_bpe")
def _(spark, sf):
    return round_trip(read(spark, sf, "documents"), *byte_bpe())


@query("op9_repeated_passages")
def _(spark, sf):
    return repeated_passages(read(spark, sf, "documents"))


@query("op10_html_text")
def _(spark, sf):
    return extract(read(spark, sf, "pages"))


@query("op11_whitening")
def _(spark, sf):
    return whiten(read(spark, sf, "embeddings"))


@query("op12_pii")
def _(spark, sf):
    return personal_data(read(spark, sf, "documents"))


@query("op13_spelling_variants")
def _(spark, sf):
    return spelling_variants(read(spark, sf, "documents"))
