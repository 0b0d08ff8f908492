import random

import pytest
from pyspark.sql import functions as F

from conftest import table
from test_dedup import brute_pairs, variants
from textloom.functions import vectorized as V
from textloom.operators import blocks as B
from textloom.operators import dedup as D


@pytest.mark.parametrize("least", [512, 8])
def test_pairs_over_several_blocks_are_exact(spark, monkeypatch, least):
    monkeypatch.setattr(B, "LEAST_BLOCK", least)
    rng = random.Random(4)
    texts = variants(60) + ["x" * n for n in (1, 4, 5, 900)] + [t * 3 + rng.choice("uv") for t in variants(8, seed=7)]
    got = D.jaccard_pairs(D.shingle_sets(table(spark, texts))).collect()
    assert len(got) == len({(r["i"], r["j"]) for r in got})
    assert {(r["i"], r["j"]) for r in got} == brute_pairs(texts, 0.5)


def test_unlike_texts_of_common_shingles_make_no_rows(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(120)]
    sets = D.shingle_sets(table(spark, texts))
    close = B.close_pairs(B.sketched(sets), 0.5)
    assert brute_pairs(texts, 0.5) <= {(r["i"], r["j"]) for r in close.collect()}
    assert close.count() < 120 * 119 // 2 // 20


def test_large_alphabet_is_exact(spark):
    text = "".join(chr(0x4E00 + n) for n in range(9000))
    texts = [text, text[:5000] + "!" + text[5000:], text[:4600]]
    got = {(r["i"], r["j"]): r["jaccard"] for r in D.jaccard_pairs(D.shingle_sets(table(spark, texts))).collect()}
    assert {p: round(v, 9) for p, v in got.items()} == {(0, 1): round(8992 / 9001, 9), (0, 2): round(4596 / 8996, 9), (1, 2): round(4596 / 8997, 9)}


def test_sketches_bound_the_difference():
    rng = random.Random(2)
    for size in (3, 300, 3000):
        x = "".join(rng.choice("abcd ") for _ in range(size))
        y = x[: size // 2] + "".join(rng.choice("abcd ") for _ in range(size))
        a, b = V.gram_hashes(x, 5), V.gram_hashes(y, 5)
        assert a.size == len({x[p : p + 5] for p in range(max(1, len(x) - 4))})
        words = [B.np.frombuffer(V.fitted_sketch(h), dtype="u8")[None] for h in (a, b)]
        width = min(w.shape[1] for w in words)
        p, q = (B._folded(w, width) for w in words)
        assert int(B.np.bitwise_count(p ^ q).sum()) <= B.np.setxor1d(a, b).size


def test_repeated_and_null_rows_lose_no_pair(spark):
    texts = variants(20)
    rows = list(enumerate(texts)) + [(n, texts[n]) for n in range(0, 20, 3)] + [(None, texts[0]), (99, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["i"], r["j"]) for r in D.jaccard_pairs(D.shingle_sets(docs)).collect())
    assert got == sorted(brute_pairs(texts, 0.5))
