"""The subword stream through split, pack and windows, against SQL that follows the first merges."""

import duckdb

from conftest import table
from oracles import bpe
from textloom.catalog.tokenizing import BLOCK, _sql_merges, block_sums, split_sums, window_sums
from textloom.operators import bpe as B
from textloom.operators import stream as ST

CHECKED = 3  # merges that SQL follows one by one
_SUBWORDS = f"""{_sql_merges(CHECKED)},
base AS (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(body, '')) AS ch FROM b0)),
ids AS MATERIALIZED (SELECT pos, CASE WHEN unicode(c) > {0xE000} AND unicode(c) <= {0xE000 + CHECKED} THEN (SELECT count(*) FROM base) + unicode(c) - {0xE001} ELSE base.id END AS id
  FROM (SELECT unnest(string_split(body, '')) AS c, generate_subscripts(string_split(body, ''), 1) - 1 AS pos FROM b{CHECKED}) LEFT JOIN base ON ch = c),
sizes AS (SELECT total, greatest(1, floor(total * 0.1))::BIGINT AS held FROM (SELECT count(*) AS total FROM ids)),
split_ids AS MATERIALIZED (SELECT *, pos - min(pos) OVER (PARTITION BY split) AS place FROM (
  SELECT pos, id, CASE WHEN pos < total - 2 * held THEN 'train' WHEN pos < total - held THEN 'val' ELSE 'test' END AS split FROM ids, sizes))"""

SQL = {
    "splits": f"""
WITH {_SUBWORDS} SELECT split, count(*)::BIGINT AS tokens, sum(id)::BIGINT AS id_sum, sum(id * (place % 1000))::BIGINT AS placed_sum FROM split_ids GROUP BY split""",
    "blocks": f"""
WITH {_SUBWORDS} SELECT split, (place // {BLOCK})::BIGINT AS block_id, count(*)::BIGINT AS n_tokens, sum(id * (place % {BLOCK} + 1))::BIGINT AS placed_sum FROM split_ids GROUP BY ALL""",
    "windows": f"""
WITH {_SUBWORDS}, starts AS (SELECT i AS sample_id, ('0x' || left(sha1('windows:' || i), 12))::BIGINT % (total - {BLOCK}) AS start FROM range(0, 500) r(i), sizes)
SELECT sample_id, start, sum(id * (pos - start + 1)) FILTER (pos < start + {BLOCK})::BIGINT AS x_sum, sum(id * (pos - start)) FILTER (pos > start)::BIGINT AS y_sum
FROM starts JOIN ids ON pos BETWEEN start AND start + {BLOCK} GROUP BY ALL""",
}


def results(spark, model):
    placed = ST.placed_tokens(model.tokens, "chunk")
    return {"splits": split_sums(placed), "blocks": block_sums(spark, placed, len(model.vocab)), "windows": window_sums(spark, placed)}


def test_first_merges_follow_sql(spark, docs):
    found = results(spark, B.train_bpe(docs, CHECKED))
    with duckdb.connect() as db:
        db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
        for name, sql in SQL.items():
            want = db.execute(sql)
            columns = [c[0] for c in want.description]
            assert sorted(map(tuple, found[name].select(*columns).collect())) == sorted(want.fetchall()), name


def test_many_merges_follow_the_encoder_of_one_pair_at_a_time(spark):
    texts = ["the cat sat on the mat. the dog sat on the log. a cat and a dog\n" * 4, "", "that is that", "on and on and on " * 20]
    model = B.train_bpe(table(spark, texts), 30)
    stream = bpe("\n\n".join(texts), 30)[3]
    assert len(model.merges) == 30
    found = results(spark, model)
    held = max(1, int(len(stream) * 0.1))
    parts = {"train": stream[: -2 * held], "val": stream[-2 * held : -held], "test": stream[-held:]}
    want = {(s, len(ids), sum(ids), sum(v * (i % 1000) for i, v in enumerate(ids))) for s, ids in parts.items()}
    assert {tuple(r) for r in found["splits"].collect()} == want
    cut = [(s, n // BLOCK, ids[n : n + BLOCK]) for s, ids in parts.items() for n in range(0, len(ids), BLOCK)]
    assert {tuple(r) for r in found["blocks"].collect()} == {(s, n, len(ids), sum(v * (i + 1) for i, v in enumerate(ids))) for s, n, ids in cut}
    for r in found["windows"].collect():
        x, y = (stream[r["start"] + d : r["start"] + d + BLOCK] for d in (0, 1))
        assert (r["x_sum"], r["y_sum"]) == tuple(sum(v * (i + 1) for i, v in enumerate(ids)) for ids in (x, y))
