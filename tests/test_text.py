import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from conftest import table
from oracles import gzip_share, squash, symbol_share, tidy, top_share
from textloom.functions import text as T
from textloom.operators.cleaning import dropped_by_reason, with_verdict
from textloom.operators.statistics import document_compression

SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
MESSY = [
    "<li>seven <em>grey</em> herons</li>", "left\x01mid\x0e\x7fright", "wide      gap", "a\r\nb\rc", "x\n\n\n\ny", "tail \t \nnext　\nend ",
    "　 both ends \x85", "a\n \n \nb", "café été", "가가", "Å ngstrom Ω",
    "", " ", "\n\n", "😀 emoji 😀 line", "tab\tand\x1fcontrol\x1c", "plain text only",
    "資料品質決定模型上限:garbage in, garbage out", "“quotes” – dashes — …", "²³¼ ⅷ 一二 ́x",
]


def column(spark, texts, build):
    rows = table(spark, texts).select("doc_id", build(F.col("text")).alias("v")).orderBy("doc_id").collect()
    return [r["v"] for r in rows]


def test_normalize_matches_python(spark):
    assert column(spark, MESSY, T.normalize) == [tidy(t) for t in MESSY]


def test_normalize_keeps_tags_on_request(spark):
    assert column(spark, ["<b>x</b>"], lambda c: T.normalize(c, html=False)) == ["<b>x</b>"]


def test_collapse_handles_every_space(spark):
    texts = [f"a{s}b{s}{s}" for s in SPACES]
    assert column(spark, texts, T.collapse_space) == [squash(t) for t in texts]


def test_ratios_match_python(spark):
    assert column(spark, MESSY, T.symbol_ratio) == pytest.approx([symbol_share(t) for t in MESSY])
    assert column(spark, MESSY, T.repeat_ratio) == pytest.approx([top_share(t) for t in MESSY])


def test_nfc_guard_covers_everything_that_can_change(spark):
    risky = set()
    for c in map(chr, range(sys.maxunicode + 1)):
        if 0xD800 <= ord(c) <= 0xDFFF:
            continue
        if not unicodedata.is_normalized("NFC", c) or unicodedata.combining(c):
            risky.add(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            risky.add(chr(int(parts[1], 16)))
    risky |= {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    missed = table(spark, sorted(risky)).where(~F.col("text").rlike(T.NFC_SUSPECTS)).collect()
    assert not missed
    assert not table(spark, ["plain", "déjà vu", "資料品質", "Ünïcode"]).where(F.col("text").rlike(T.NFC_SUSPECTS)).collect()


@pytest.mark.parametrize("markup, expected", [
    ("x-{plain}-y", "xplainy"),
    ("-{zh-cn:甲;zh-tw:乙}-", "乙"),
    ("-{zh-cn:甲}-", "甲"),
    ("-{zh-cn: ;zh-hk:}-", ""),
    ("-{zh-cn:a;zh-cn:b;zh-sg:c}-", "b"),
    ("-{zh-cn:a;zh-hk:h;zh-hant:t}-", "t"),
    ("-{zh-cn: ;x:first;y:second}-", "first"),
    ("a-{p}-b-{zh-tw:q}-c-{open", "apbqc-{open"),
    ("-{zh-tw:1:2\n3}-", "1:2\n3"),
    ("-{}-|-{a;b}-", "|a;b"),
])
def test_variant_markup(spark, markup, expected):
    assert column(spark, [markup], T.resolve_variants) == [expected]


def test_quality_rules(spark):
    texts = ["ok?", "zz" * 90, "+=+=~~<>/|\\" * 9, "Nine old kettles whistle in the narrow kitchen all day.", ""]
    judged = with_verdict(table(spark, texts))
    reasons = [r["reason"] for r in judged.orderBy("doc_id").collect()]
    assert reasons == ["too_short", "too_repetitive", "too_many_symbols", "ok", "too_short"]
    assert {r["reason"]: r["dropped"] for r in dropped_by_reason(judged).collect()} == {
        "too_short": 2, "too_repetitive": 1, "too_many_symbols": 1}


def test_content_hash_ignores_space_runs(spark):
    a, b = column(spark, ["x  y\n z", " x y z "], T.content_hash)
    assert a == b


def test_document_compression(spark):
    texts = ["ab" * 500, "".join(chr(33 + (i * 7919) % 90) for i in range(1000)), ""]
    got = [r["compression_ratio"] for r in document_compression(table(spark, texts)).orderBy("doc_id").collect()]
    assert got == pytest.approx([gzip_share(t) for t in texts])
    assert got[0] < got[1]
