import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from textloom.functions import coding
from textloom.functions.coding import decode_column, encode_column, merge_column
from textloom.operators import bpe

IDS = [[1, 2, 1, 2, 2], [], None, [2, 1], [1, 1, 2]]


@pytest.mark.parametrize("most", [1, 3, 1 << 20])
def test_slices_make_no_difference(monkeypatch, most):
    monkeypatch.setattr(coding, "SLICE_CHARS", most)
    lists = pa.array([[9], *IDS], pa.list_(pa.int32()))[1:]  # an array that starts inside its buffers
    assert merge_column(1, 2, 7).func(lists).to_pylist() == [[7, 7, 2], [], [], [2, 1], [1, 7]]
    assert decode_column("abc").func(lists).to_pylist() == ["bcbcc", "", None, "cb", "bbc"]
    texts = pa.array(["ab\U0001d11eab", None, "", "aab"])
    assert encode_column("ab\U0001d11e", [(0, 1, 3)]).func(texts).to_pylist() == [[3, 2, 3], [], [], [0, 3]]
    assert merge_column(1, 2, 7).func(lists[:0]).to_pylist() == encode_column("ab").func(texts[:0]).to_pylist() == []


def test_a_batch_takes_memory_in_proportion_to_its_ids():
    """A number of Python for each id would take 32 bytes of it and 8 of a list."""
    ids = np.arange(4_000_000, dtype=np.int32) % 1000 + 1000
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, 1000, dtype=np.int32)), pa.array(ids))
    decode, merge = decode_column(["x"] * 2000).func, merge_column(1, 2, 2000).func
    for job in (decode, merge):
        tracemalloc.start()
        job(lists)
        assert tracemalloc.get_traced_memory()[1] < 24 * ids.size
        tracemalloc.stop()


@pytest.mark.parametrize("size", [4, 40])
def test_pairs_are_counted_over_the_chunks_of_a_task(size):
    draw = np.random.default_rng(1)
    chunks = {n: draw.integers(0, 4, 60, dtype=np.int32) for n in (5, 2, 9)}
    counts = bpe._PairCounts(size)
    want: dict = {}
    for n, ids in chunks.items():
        counts.add(n, ids)
        for at, pair in enumerate(zip(ids.tolist(), ids[1:].tolist())):
            seen = want.get(pair, (0, (n, at)))
            want[pair] = (seen[0] + 1, min(seen[1], (n, at)))
    rows = counts.batch().to_pylist()
    assert {(r["left"], r["right"]): (r["n"], (r["chunk"], r["at"])) for r in rows} == want


def test_a_task_gives_one_row_per_pair(spark):
    """As many rows as chunks times pairs would grow with the stream."""
    rows = [(n, [0, 1, 2] * 20) for n in range(40)]
    tokens = spark.createDataFrame(rows, "chunk bigint, ids array<int>").coalesce(1)
    found = bpe._pass_statistics(tokens, [], 3).where("NOT edge")
    assert found.count() == 3 and found.agg({"n": "sum"}).first()[0] == 40 * 59


def test_a_task_without_pairs_gives_edges_alone(spark):
    tokens = spark.createDataFrame([(0, [1]), (1, [2])], "chunk bigint, ids array<int>").coalesce(1)
    assert [r["edge"] for r in bpe._pass_statistics(tokens, [], 3).collect()] == [True, True]
