import random

import pytest
from pyspark.sql import functions as F

from conftest import table
from oracles import greedy, minhash, shingle_set
from textloom.functions import text as T
from textloom.operators import dedup as D


def keys(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def variants(n, seed=3):
    """Texts of several families: copies, near copies, templates, strangers."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(120)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    out = []
    for _ in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 12, 40])):
            text[rng.randrange(len(text))] = rng.choice("xyz ")
        out.append("".join(text))
    return out + ["", " ", "abc", "abc"]


def test_exact_dedup_keeps_first(spark):
    assert keys(D.exact_dedup(table(spark, ["a b", "a  b", "c"]))) == [0, 2]


def test_shingles(spark):
    texts = ["", "abc", "abcde", "abcdef", "aaaaaaaaa", "日本語テキスト😀です"]
    rows = table(spark, texts).select("doc_id", T.shingles(F.col("text")).alias("s")).orderBy("doc_id").collect()
    assert [set(r["s"]) for r in rows] == [shingle_set(t) for t in texts]


def test_minhash_matches_direct_computation(spark):
    texts = variants(6) + ["日本語テキスト😀です、長い文", "é" * 9, "naïve café " * 900]
    rows = D.signatures(table(spark, texts)).orderBy("doc_id").collect()
    assert [r["sig"] for r in rows] == [minhash(t) for t in texts]


@pytest.mark.parametrize("front", [256, 2, 5])
def test_near_dedup_equals_sequential_scan(spark, front):
    texts = variants(90)
    cfg = D.NearDupConfig(front=front, salt_rows=4)
    assert keys(D.near_dedup(table(spark, texts), cfg=cfg)) == greedy(texts)


def test_near_dedup_drops_one_edit(spark):
    ledger = "\n".join(f"Row {n}: the harbour office booked {n * 37 % 101} crates of dried plums on pier {n % 7}." for n in range(12))
    texts = [ledger, ledger.replace("dried plums", "salted fish", 1), "Sixteen grey geese crossed the frozen reservoir before the ferry left."]
    assert keys(D.near_dedup(table(spark, texts))) == [0, 2]


def brute_pairs(texts, threshold, k=5):
    import re
    sets = []
    for t in texts:
        s = re.sub(r"\s+", " ", t)
        sets.append({s[i:i + k] for i in range(max(1, len(s) - k + 1))})
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    reps = sorted(first.values())
    return {(i, j) for i in reps for j in reps if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > threshold}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_jaccard_join_is_exact(spark, threshold):
    texts = variants(60)
    sets = D.shingle_sets(table(spark, texts))
    got = {(r["i"], r["j"]) for r in D.jaccard_pairs(sets, threshold=threshold).collect()}
    assert got == brute_pairs(texts, threshold)


def test_banded_join_is_a_subset_and_finds_known_copies(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(150)) for _ in range(50)]
    known = []
    for n in range(10):
        copy = list(texts[n])
        for _ in range(2):
            copy[rng.randrange(len(copy))] = " "
        known.append((n, len(texts)))
        texts.append("".join(copy))
    docs = table(spark, texts)
    sets = D.shingle_sets(docs)
    exact = D.jaccard_pairs(sets)
    found = D.lsh_jaccard_pairs(docs)
    candidates = D.wide_candidates(docs, sets)
    report = D.dedup_accuracy(sets, candidates, exact, found, spark.createDataFrame(known, "i bigint, j bigint")).first()
    assert found.select("i", "j").exceptAll(exact.select("i", "j")).isEmpty()
    assert report["candidates"] < report["all_pairs"] == 60 * 59 // 2
    assert report["known_found"] >= 8 and report["recall"] <= 1.0
