import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import table
from oracles import bpe, merge_ids
from textloom.functions.coding import MergeRanks, count_windows, merge_column, merge_pair
from textloom.operators import bpe as B
from textloom.operators import stream as ST
from textloom.operators import tokens as K

TEXT = "the cat sat on the mat. the dog sat on the log.\n" * 3


def corpus(texts):
    return "\n\n".join(texts)


@pytest.mark.parametrize("ids, pair, expected", [
    ([1, 2, 1, 2, 3], (1, 2), [99, 99, 3]), ([1, 1, 1], (1, 1), [99, 1]), ([1, 1, 1, 1, 2, 1, 1], (1, 1), [99, 99, 2, 99]), ([], (1, 2), []), ([5], (5, 5), [5]),
])
def test_merge_pair(spark, ids, pair, expected):
    assert merge_pair(np.array(ids, dtype=np.int32), *pair, 99).tolist() == expected
    row = spark.createDataFrame([(ids,)], "ids array<int>").select(merge_column(*pair, 99)(F.col("ids")).alias("m")).first()
    assert row["m"] == expected


def test_merge_pair_random_runs():
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 20))]
        for pair in ((1, 1), (1, 2), (2, 1)):
            assert merge_pair(np.array(ids, dtype=np.int32), *pair, 9).tolist() == merge_ids(ids, pair, 9)


def test_ranked_merges_equal_one_merge_at_a_time():
    draw = np.random.default_rng(6)
    for trial in range(300):
        base = int(draw.integers(1, 5))
        merges = []
        for step in range(int(draw.integers(0, 30))):
            left, right = draw.integers(0, base + step, size=2).tolist()
            merges.append((left, right, base + step))
        ids = draw.integers(-1 if trial % 3 else 0, base, size=int(draw.integers(0, 200))).astype(np.int32)
        want = ids
        for step, merge in enumerate(merges):
            if merge[:2] not in [m[:2] for m in merges[:step]]:
                want = merge_pair(want, *merge)
        assert MergeRanks(merges).apply(ids).tolist() == want.tolist()


@pytest.mark.parametrize("order", [1, 2, 4])
def test_count_windows(order):
    texts = ["abcabc", "", "ab", "日本語日本語", "😀😀😀"]
    want = {}
    for t in texts:
        for i in range(len(t) - order + 1):
            want[t[i:i + order]] = want.get(t[i:i + order], 0) + 1
    grams, counts = count_windows(texts, order)
    assert dict(zip(grams, counts.tolist())) == want


@pytest.mark.parametrize("chunk_chars", [1 << 20, 1])
@pytest.mark.parametrize("texts", [
    ["abababab"], ["aaaa", "aaa", "aaaaa"], ["the cat", "sat on the", "mat the cat"], ["\n", "\n\n", "a", "", "\n"], [TEXT, TEXT[::-1]],
])
def test_bpe_training_equals_one_pair_at_a_time(spark, texts, chunk_chars):
    base, rules, log, ids = bpe(corpus(texts), 8)
    model = B.train_bpe(table(spark, texts), 8, chunk_chars=chunk_chars)
    assert model.base == base
    assert model.merges == rules
    assert [(e[4], e[6]) for e in model.log] == log
    learned = [i for r in model.tokens.orderBy("chunk").collect() for i in r["ids"]]
    assert learned == ids


@pytest.mark.parametrize("chunk_chars, rim, ranked", [(1 << 20, 48, 4096), (150, 48, 4096), (150, 6, 12), (40, 3, 40)])
def test_merges_tried_ahead_are_those_of_one_pair_at_a_time(spark, monkeypatch, chunk_chars, rim, ranked):
    """Passes are fewer than merges, whatever is seen of the borders and of the ranking; a pass takes no row of a whole table at once."""
    monkeypatch.setattr(B, "RIM", rim)
    monkeypatch.setattr(B, "RANKED", ranked)
    monkeypatch.setattr(B, "REWRITE_AFTER", 20)
    rng = random.Random(chunk_chars + rim)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(25)] + ["aaaa", "aaaaaaa", "   "]
    texts = [" ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(1, 60))) for _ in range(60)]
    base, rules, log, ids = bpe(corpus(texts), 60)
    passes = []
    counted = B._pass_statistics
    monkeypatch.setattr(B, "_pass_statistics", lambda *a: passes.append(len(a[-1])) or counted(*a))
    model = B.train_bpe(table(spark, texts), 60, chunk_chars=chunk_chars)
    assert (model.base, model.merges) == (base, rules)
    assert [(e[4], e[6]) for e in model.log] == log
    assert [i for r in model.tokens.orderBy("chunk").collect() for i in r["ids"]] == ids
    assert any(passes) and (len(passes) < 30 or rim < 48)


@pytest.mark.parametrize("dense", [True, False])
def test_merger_counts_what_each_merge_changes(monkeypatch, dense):
    monkeypatch.setattr(B, "DENSE_PAIRS", 1 << 22 if dense else 0)
    draw = np.random.default_rng(7)
    for _ in range(200):
        size = int(draw.integers(1, 4))
        ids = draw.integers(0, size, int(draw.integers(1, 60))).astype(np.int32)
        merges, own, states = [], ids, [ids]
        for _ in range(int(draw.integers(1, 8))):
            if own.size < 3:
                break
            at = int(draw.integers(0, own.size - 1))
            left, right, new = int(own[at]), int(own[at + 1]), size + len(merges)
            yields = bool(own[0] == right and draw.integers(2))
            rest = merge_pair(own[1:] if yields else own, left, right, new)
            absorbs, yields = (np.array([5] if x else [], dtype=np.int64) for x in (rest[-1] == left and draw.integers(2), yields))
            merges.append(B.Merge(left, right, new, absorbs, yields))
            own = B._apply(5, own, merges[-1:])
            states.append(own)
        merger = B._Merger(merges, size + len(merges), dense)
        assert merger.apply(5, ids).tolist() == own.tolist()
        if not dense:
            continue
        changed = B._changes_batch(merger).to_pydict()
        for step, (x, y) in enumerate(zip(states, states[1:])):
            want = {}
            for state, sign in ((x, -1), (y, 1)):
                for pair in zip(state[:-1].tolist(), state[1:].tolist()):
                    want[pair] = want.get(pair, 0) + sign
            got = {}
            for s, left, right, n in zip(*(changed[c] for c in ("step", "left", "right", "n"))):
                if s == step:
                    got[left, right] = got.get((left, right), 0) + n
            assert got.pop((-1, -1)) == x.size - y.size
            merged = (merges[step].left, merges[step].right)
            assert merged not in list(zip(y[:-1].tolist(), y[1:].tolist())) or merges[step].absorbs.size
            assert {p: n for p, n in got.items() if n and p != merged} == {p: n for p, n in want.items() if n and p != merged}


def test_bpe_round_trip_and_persistence(spark, tmp_path):
    docs = table(spark, [TEXT])
    model = B.train_bpe(docs, 20)
    coded = B.encode_bpe(docs, model).first()["ids"]
    assert "".join(model.vocab[i] for i in coded) == TEXT and len(coded) < len(TEXT)
    B.save_tokenizer(spark, str(tmp_path), model.base, model.merges)
    again = B.load_tokenizer(spark, str(tmp_path))
    assert B.encode_bpe(docs, again).first()["ids"] == coded
    B.save_tokenizer(spark, str(tmp_path / "c"), ["a", "b"])
    assert B.load_tokenizer(spark, str(tmp_path / "c")).merges == []
    skipped = B.encode_bpe(table(spark, ["the é cat"]), model).first()["ids"]
    assert "".join(model.vocab[i] for i in skipped) == "the  cat"


def test_bpe_views(spark):
    model = B.train_bpe(table(spark, [TEXT]), 20)
    assert B.merge_log(spark, model).count() == len(model.merges)
    report = B.bpe_report(spark, model).first()
    assert report["orig_chars"] == len(TEXT) and report["compression"] < 1
    longest = [r["length"] for r in B.longest_fragments(B.vocabulary_table(spark, model)).collect()]
    assert longest == sorted(longest, reverse=True)
    assert {r["step"] for r in B.monitor_view(B.merge_log(spark, model), 3, 10).collect()} == {1, 2, 3, 10, len(model.merges)} | ({20} if len(model.merges) >= 20 else set())


def test_unknown_character_is_an_error(spark):
    vocab = K.char_vocabulary(table(spark, ["abc"]))
    assert K.encode_chars(table(spark, ["cab"]), vocab).first()["ids"] == [2, 0, 1]
    with pytest.raises(PySparkException):
        K.encode_chars(table(spark, ["xyz"]), vocab).collect()


@pytest.mark.parametrize("vocab_size, expected", [(65535, "uint16"), (65536, "uint32")])
def test_token_width(spark, vocab_size, expected):
    assert spark.range(1).select(K.token_dtype(F.lit(vocab_size))).first()[0] == expected


@pytest.mark.parametrize("texts", [["hello", "", "x", "world wide"], ["a"], ["one two three four five six seven eight nine ten"] * 5])
def test_splits_blocks_and_pairs_follow_the_stream(spark, texts):
    whole = corpus(texts)
    placed = ST.placed_units(table(spark, texts)).persist()
    pieces = ST.split_pieces(placed).orderBy("lo").collect()
    n_test = max(1, int(len(whole) * 0.1))
    n_val = max(1, int(len(whole) * 0.1))
    joined = {s: "".join(p["piece"] for p in pieces if p["split"] == s) for s in ST.SPLITS}
    if len(whole) >= 3:
        assert joined == {"train": whole[:-(n_val + n_test)], "val": whole[-(n_val + n_test):-n_test], "test": whole[-n_test:]}
    blocks = K.stream_blocks(placed, 4).orderBy("block_id").collect()
    assert "".join(b["tokens"] for b in blocks) == whole
    assert all(len(b["tokens"]) == 4 for b in blocks[:-1])
    want = {}
    for pair in zip(whole, whole[1:]):
        want[pair] = want.get(pair, 0) + 1
    got = {(r["left"], r["right"]): r["n"] for r in K.pair_counts(placed.withColumn("piece", F.col("unit"))).collect()}
    assert got == want
    for order in (1, 3, 4):
        grams = {}
        for i in range(len(whole)):
            g = whole[max(0, i - order + 1):i + 1]
            grams[g] = grams.get(g, 0) + 1
        found = ST.maximal_grams(placed.withColumn("piece", F.col("unit")), order, by=None)
        assert {r["gram"]: r["n"] for r in found.collect()} == grams
    placed.unpersist()


def test_windows_are_shifted_slices(spark):
    whole = corpus(["abcdefghij", "klmnopqrst", "uvwxyz"])
    placed = ST.placed_units(table(spark, whole.split("\n\n")))
    starts = spark.createDataFrame([(i, i) for i in range(len(whole) - 8)], "sample_id bigint, start bigint")
    for r in K.training_windows(K.stream_blocks(placed, 8), starts, 8).collect():
        assert r["x"] == whole[r["start"]:r["start"] + 8] and r["y"] == whole[r["start"] + 1:r["start"] + 9]


def test_token_stream_is_split_packed_and_windowed(spark):
    rng = random.Random(7)
    rows = [(k, [rng.randrange(900) for _ in range(rng.choice([0, 1, 5, 40]))]) for k in range(60)]
    stream = [i for _, ids in rows for i in ids]
    placed = ST.placed_tokens(spark.createDataFrame(rows, "chunk bigint, ids array<int>"), "chunk").persist()
    held = max(1, int(len(stream) * 0.1))
    want = {"train": stream[: -2 * held], "val": stream[-2 * held : -held], "test": stream[-held:]}
    pieces = ST.token_splits(placed)
    for split, ids in want.items():
        got = pieces.where(F.col("split") == split).orderBy("at").collect()
        assert [i for r in got for i in r["ids"]] == ids
    blocks = {(r["split"], r["block_id"]): r["ids"] for r in ST.token_blocks(pieces, 16).collect()}
    assert blocks == {(s, n // 16): ids[n : n + 16] for s, ids in want.items() for n in range(0, len(ids), 16)}
    starts = spark.createDataFrame([(n, n * 7) for n in range((len(stream) - 17) // 7)], "sample_id bigint, start bigint")
    for r in ST.token_windows(ST.token_blocks(placed, 16, by=(), at="start"), starts, 16).collect():
        assert r["x"] == stream[r["start"] : r["start"] + 16] and r["y"] == stream[r["start"] + 1 : r["start"] + 17]
