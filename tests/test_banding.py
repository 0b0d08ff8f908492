import pytest

from test_dedup import keys
from textloom.operators import banding as B
from textloom.operators import dedup as D

SCHEMA = "doc_id bigint, sig array<bigint>"


def strangers(n):
    """Signatures that share their first band and nothing else."""
    return [[1, 2, 3, 4] + [1000 * at + v for v in range(60)] for at in range(1, n + 1)]


def brute(rows, least, r=4):
    found = []
    for i, a in rows:
        for j, b in rows:
            if i is not None and j is not None and i < j and any(a[q:q + r] == b[q:q + r] for q in range(0, 64, r)):
                share = sum(x == y for x, y in zip(a, b)) / 64
                if share >= least:
                    found.append((i, j, share))
    return sorted(found)


def test_a_large_bucket_takes_few_rounds(spark, monkeypatch):
    sigs = strangers(60)
    sigs[50] = sigs[3][:44] + sigs[50][44:]
    table = spark.createDataFrame(list(enumerate(sigs)), SCHEMA)
    sizes = []
    settle = D._front_round
    monkeypatch.setattr(D, "signatures", lambda *a: table)
    monkeypatch.setattr(D, "_front_round", lambda *a: sizes.append(1) or settle(*a))
    assert keys(D.near_dedup_keys(table, cfg=D.NearDupConfig(front=2, salt_rows=8))) == [n for n in range(60) if n != 50]
    assert 0 < len(sizes) <= 6


@pytest.mark.parametrize("block, cell", [(1024, 4000), (3, 10), (1, 1)])
def test_candidates_come_from_the_buckets_alone(spark, monkeypatch, block, cell):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "CELL_ROWS", cell)
    monkeypatch.setattr(B, "PAIRS", 7)
    sigs = strangers(9)
    sigs[4], sigs[6] = sigs[2][:60] + [7, 8, 9, 1 << 40], [5] * 64
    rows = [*enumerate(sigs), (3, sigs[2][:8] + sigs[8][8:]), (None, sigs[1][:4] + sigs[6][4:])]  # ids may repeat or be null
    found = D.candidate_pairs(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # members meet the sizes of their buckets; no pair is joined
