"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import licenses, secret_scan
from textloom.llm.bpe_codec import decode, encode, round_trip
from textloom.llm.decontaminate import overlaps
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.language import identify
from textloom.llm.near_texts import near_duplicates
from textloom.llm.pages import extract
from textloom.llm.passages import repeated_passages
from textloom.llm.quality import classify
from textloom.llm.queries import byte_bpe
from textloom.llm.simhash import simhash_dedup

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "plain words of a small text", "en", "a", 3),
    (1, "plain words of a small text", "en", "a", 3),  # a repeated row
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "de", "b", 3),
    (None, "a text whose id is missing", None, "b", 1),
    (None, "a text whose id is missing", None, "b", 1),
    (5, LONG, "en", "a", 9),
    (6, "plain words of a small text", "en", "a", 3),  # a tie with 1
    (7, "\U0001f600 é ß \x00 ok", "fr", "c", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use for columns of their own.
CLASHING = "fp mask part seed key words digest blob rules score label kept component_id _kept_id _rank w0 rep at h".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, 0), (3, 0, 0), (None, 1, None), (7, None, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, LONG[:200]), (2, None), (3, ""), (None, "a b c d e f g")], "item_id bigint, text string")


def operators(labels, benchmark):
    return {
        "simhash": simhash_dedup, "near": near_duplicates, "licenses": licenses.recognise, "quality": lambda d: classify(d, labels),
        "decontaminate": lambda d: overlaps(d, benchmark), "secrets": secret_scan.secrets, "exact": exact_dedup, "language": identify,
        "bpe": lambda d: round_trip(d, *byte_bpe()), "passages": repeated_passages,
    }


#: Operators that return a row for each row; the others list findings.
PER_ROW = ("simhash", "near", "licenses", "quality", "secrets", "exact", "language", "bpe")


@pytest.mark.parametrize("name", ["simhash", "near", "licenses", "quality", "decontaminate", "secrets", "exact", "language", "bpe", "passages"])
def test_odd_rows(spark, docs, labels, benchmark, name):
    operator = operators(labels, benchmark)[name]
    rows = sorted(map(str, operator(docs).collect()))
    if name in PER_ROW:
        assert len(rows) == len(ROWS)
    clashing = docs.withColumns({c: F.lit("x") for c in CLASHING})
    assert sorted(map(str, operator(clashing).collect())) == rows
    assert operator(docs.limit(0)).collect() == []


def by_id(frame, column):
    out = {}
    for r in frame.collect():
        out.setdefault(r["doc_id"], []).append(r[column])
    return out


def test_defined_results(spark, docs, labels, benchmark):
    exact = by_id(exact_dedup(docs), "kept")
    assert sorted(exact[1]) == [False, False] and exact[6] == [True]
    assert exact[2] == [False] and exact[3] == [True]  # null counts as empty
    assert sorted(exact[None]) == [False, True]
    near = by_id(near_duplicates(docs), "component_id")
    assert near[6] == [1] and near[2] == near[3] == near[4] == [2]
    prints = by_id(simhash_dedup(docs), "fingerprint")
    assert prints[2] == prints[3] == prints[4] == ["0" * 16]
    language = by_id(identify(docs), "lang_pred")
    assert language[2] == language[3] == language[4] == ["und"]
    tokens = by_id(round_trip(docs, *byte_bpe()), "n_tokens")
    assert tokens[2] == tokens[3] == [0]
    found = overlaps(docs, benchmark).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(5, 1)]
    assert all(0 <= s <= 1 for scores in by_id(classify(docs, labels), "score").values() for s in scores)


def test_no_labels(spark, docs, labels):
    assert {r["score"] for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["lang_pred"] for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_decode_takes_nulls(spark, docs):
    ranks, pattern = byte_bpe()
    coded = encode(docs, ranks, pattern)
    raw = {r["doc_id"]: bytes(r["bytes"]).decode() for r in decode(coded, ranks, pattern).collect()}
    assert raw[5] == LONG and raw[7] == ROWS[9][1] and raw[2] == ""
    empty = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert bytes(decode(empty, ranks, pattern).first()["bytes"]) == b""


def test_odd_pages(spark):
    rows = [
        (1, "http://a.example/x", None), (2, None, "<p>one</p>"), (2, None, "<p>one</p>"), (None, "not a url", ""),
        (3, "http://a.example/y", "<p>" + "long words " * 50_000 + "</p>"), (4, "http://a.example/z", "<<<>>><p <p>x"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r["page_id"] or 0, r["n_chars"]) for r in extract(pages).collect()))
    assert [g[0] for g in got] == [0, 1, 2, 2, 3, 4] and got[4][1] == len("long words " * 50_000) - 1
    assert dict(got)[2] == 3 and dict(got)[1] == 0
    clashing = pages.withColumns({c: F.lit("x") for c in ("host", "path", "lines", "part", "role", "text")})
    assert sorted(((r["page_id"] or 0, r["n_chars"]) for r in extract(clashing).collect())) == got
    assert extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, docs, labels, benchmark, tmp_path, number):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[number]
    extra = docs.withColumns({c: F.lit("x") for c in CLASHING})
    for table in (docs, extra):
        out = stage(spark, table, str(tmp_path))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == table.columns
        out = out.collect()
        ids = [r["doc_id"] for r in out]
        assert all(i in {1, 2, 3, 4, 5, 6, 7, None} for i in ids)
        if name == "exact_dedup":
            assert sorted(i for i in ids if i) == [3, 4, 5, 6, 7] and ids.count(None) == 1
        if name == "decontaminate":
            assert 5 not in ids and ids.count(1) == 2 and ids.count(None) == 2
        if name == "byte_bpe":
            assert len(out) == len(ROWS)
        assert stage(spark, table.limit(0), str(tmp_path)).collect() == []
