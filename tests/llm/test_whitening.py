"""Whitening against a direct eigenvalue decomposition, and its solver on awkward matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>"


def matrices():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 9, 20, 47):
        a = rng.standard_normal((size, size))
        yield "plain", a
        yield "graded", a * 10.0 ** rng.uniform(-8, 8, size)
        yield "one rank", a[:, :1] @ rng.standard_normal((1, size))
        yield "diagonal", np.diag(rng.integers(0, 3, size).astype(float))
        yield "clusters", np.linalg.qr(a)[0] * np.repeat([3.0, 3.0, 1.0], 30)[:size]


@pytest.mark.parametrize("kind, a", matrices())
def test_solver(kind, a):
    factor = np.linalg.qr(a, mode="r")
    true = np.linalg.svd(factor, compute_uv=False)
    values, vectors = W.principal(factor, 8)
    assert len(values) >= min(8, int((true > true[0] * 1e-12).sum()))
    top = max(true[0], 1e-300)
    assert np.allclose(np.sqrt(values) / top, true[: len(values)] / top, atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-11)
    assert np.allclose(factor.T @ (factor @ vectors) / top**2, vectors * values / top**2, atol=1e-12)


def test_small_values_keep_their_digits():
    """Relative accuracy: values of a graded bidiagonal matrix down to 1e-30 of the largest."""
    d, e = 10.0 ** -np.arange(0, 31, 3.0), np.full(10, 0.5) * 10.0 ** -np.arange(0, 30, 3.0)
    product = 1.0
    for v in W.qd_values(d, e):
        product *= v
    assert product == pytest.approx(float(np.prod(d * d)), rel=1e-10)


def by_hand(rows):
    """(ids, exact deviations, whitened rows, explained shares) by an eigenvalue decomposition."""
    kept = [(k, v) for k, v in rows if v is not None and None not in v and all(map(math.isfinite, v))]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept], dtype=object)
    n, total = len(x), x.sum(axis=0)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    centred = (x - total / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    return [k for k, _ in kept], deviation, centred @ v / np.sqrt(e), e / ((centred**2).sum() / n)


def compare(result, rows):
    ids, deviation, whitened, explained = by_hand(rows)
    width = whitened.shape[1]
    got = result.collect()
    assert len(got) == len(ids) * width and {r["n"] for r in got} == {len(ids)}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    table = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(1, width + 1):
        mine = np.array([table[k, c]["whitened"] for k in ids])
        sign = np.sign(mine @ whitened[:, c - 1])
        assert np.allclose(mine * sign, whitened[:, c - 1], atol=1e-6)
        assert all(table[k, c]["deviation"] == deviation[i] for i, k in enumerate(ids))
        assert table[ids[0], c]["explained"] == pytest.approx(explained[c - 1], rel=1e-9)


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_against_decomposition(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(12) * np.arange(1, 13)).tolist()) for i in range(300)]
    rows += [(900, None), (901, [None] + [0.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] + [1.0] * 11), (904, []), (905, [1.0, 2.0])]
    usable = [(k, v) for k, v in rows if k < 900]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    compare(W.whiten(frame), usable)
    clashing = frame.withColumns({c: F.lit("x") for c in ("n", "at", "factor", "component", "sums", "dims", "label")})
    compare(W.whiten(clashing), usable)


def test_query_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    compare(W.whiten(table), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.whiten(empty).collect() == [] and W.whiten(empty).columns == [f.split()[0] for f in W.SCHEMA.split(", ")]
    assert W.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)).collect() == []  # no variance, no direction
    flat = W.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 4.0])], SCHEMA)).collect()
    assert sorted((r["vec_id"] is None, r["component"], round(r["whitened"], 6)) for r in flat) == sorted(
        [(True, 1, -0.707107), (True, 1, -0.707107), (False, 1, 1.414214)])


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(i, [float(10**9 * (i % 2)), 0.0]) for i in range(4000)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 4000 and all(r["deviation"] is None for r in got)
    assert W.exact_squares(np.array([[2**40, 1]])).tolist() == [2**80 + 1]
