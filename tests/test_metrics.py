import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import table
from oracles import entropy
from textloom.operators import detectors as Q
from textloom.operators import drift as D
from textloom.operators import governance as J
from textloom.operators import ngrams as N
from textloom.operators import scoring as H
from textloom.operators import statistics as S
from textloom.operators import stream as ST
from textloom.operators import telemetry as K
from textloom.operators import trainsets as G


# ---- statistics and detectors ----------------------------------------------

@pytest.mark.parametrize("text, bits", [("aaaa", 0.0), ("abab", 1.0), ("hello world", None), ("", 0.0)])
def test_entropy(spark, text, bits):
    got = S.entropy_of(S.stream_char_counts(table(spark, [text]))).first()["entropy"]
    assert got == pytest.approx(entropy(text) if bits is None else bits)


def test_stream_statistics_count_separators(spark):
    docs = table(spark, ["ab", "b", "ccc"])
    whole = "ab\n\nb\n\nccc"
    assert S.entropy_of(S.stream_char_counts(docs)).first()["total_chars"] == len(whole)
    top = [(r["ch"], r["n"]) for r in S.top_characters(docs, top=4).collect()]
    assert top == [("\n", 4), ("c", 3), ("b", 2), ("a", 1)]
    ties = [r["ch"] for r in S.top_characters(table(spark, ["zyx", "xyzq"]), top=3).collect()]
    assert ties == ["z", "y", "x"]


def test_length_summary_uses_upper_median(spark):
    row = S.length_summary(table(spark, ["a", "bb", "ccc", "dddd"])).first()
    assert (row["count"], row["min"], row["max"], row["mean"], row["median"]) == (4, 1, 4, 2.5, 3)


@pytest.mark.parametrize("value, status", [(0.5, "healthy"), (0.25, "warn"), (0.1, "bad"), (0.9, "warn"), (1.2, "bad")])
def test_health_bands(spark, value, status):
    assert spark.range(1).select(S.health_status(F.lit(value), F.lit(0.3), F.lit(0.7))).first()[0] == status


def test_detector_gate_and_samples(spark):
    docs = table(spark, ["clean text " * 10, "x" * 30 + "-{zh-tw:a;zh-cn:b}-" + "y\n" * 30])
    row = Q.report_document(docs).first()
    wiki = row["detectors"][0]
    assert (row["total_docs"], row["all_pass"], wiki["name"], wiki["hits"], wiki["pct"]) == (2, False, "wiki_markup", 1, 50.0)
    assert wiki["samples"] == ["…" + "x" * 25 + "-{zh-tw:a;zh-cn:b}-" + ("y " * 30)[:25] + "…"]


def test_detector_list_is_extensible(spark):
    own = [*Q.DETECTORS, Q.pattern_detector("shouting", "[A-Z]{5,}", 0.0, "capitals")]
    rows = {r["name"]: r for r in Q.detector_report(table(spark, ["HELLO WORLD"]), detectors=own).collect()}
    assert rows["shouting"]["hits"] == 1 and not rows["shouting"]["pass"]


def test_history_keeps_ten_and_replaces_labels(spark):
    history = spark.createDataFrame([(f"r{i}", i, True, {"url": float(i)}) for i in range(12)], "label string, seq bigint, all_pass boolean, pct map<string,double>")
    entry = Q.history_entry(Q.detector_report(table(spark, ["short"])), F.lit("r5"))
    rows = Q.upsert_history(history, entry).collect()
    assert [r["label"] for r in rows] == ["r5", "r11", "r10", "r9", "r8", "r7", "r6", "r4", "r3", "r2"]


# ---- n-grams ---------------------------------------------------------------

def backoff(train, text, order, vocab, k=0.05):
    tables = [{} for _ in range(order + 1)]
    for i in range(len(train)):
        for m in range(1, order + 1):
            if i >= m - 1:
                row = tables[m].setdefault(train[i - m + 1:i], {})
                row[train[i]] = row.get(train[i], 0) + 1
    bits = 0.0
    for i in range(len(text)):
        p = 1 / vocab
        for m in range(min(order, i + 1), 0, -1):
            row = tables[m].get(text[i - m + 1:i])
            if row:
                p = (row.get(text[i], 0) + k) / (sum(row.values()) + k * vocab)
                break
        bits -= math.log2(p)
    return bits / len(text)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_backoff_matches_direct_computation(spark, order):
    texts = ["the cat sat on the mat", "the dog ate the cat's hat", "a man, a plan, a canal"]
    placed = ST.placed_units(table(spark, texts)).persist()
    grams = ST.maximal_grams(ST.split_pieces(placed, 0.2, 0.2), order).persist()
    whole = "\n\n".join(texts)
    n = int(len(whole) * 0.2)
    train, val = whole[:-2 * n], whole[-2 * n:-n]
    model = N.ngram_table(grams.where("split = 'train'").drop("split"))
    scored = N.backoff_probabilities(grams.where("split = 'val'").drop("split"), model, F.lit(30))
    assert N.bits_per_character(scored).first()["bpc"] == pytest.approx(backoff(train, val, order, 30))


# ---- training sets ---------------------------------------------------------

def test_default_definition_rule(spark):
    docs = table(spark, ["數學是研究數量、結構以及空間等概念的一門學科。後文", "數學是另一個同名條目而且也夠長的定義句。", "A是太短。", "物理，學是研究物質與能量的自然科學。", "化學是研究物質組成性質與變化的科學。"])
    items = G.clean_titles(G.definitions(docs))
    rows = items.orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"]) for r in rows] == [(0, "數學"), (4, "化學")]
    pair = G.instruction_pairs(items).orderBy("doc_id").first()
    assert pair["q"] == "什麼是數學？" and pair["a"] == "數學是研究數量、結構以及空間等概念的一門學科。"
    bad = G.degenerate_pairs(items).orderBy("doc_id").first()["rejected"]
    body = rows[0]["body"]
    assert bad == "數學是" + body[:2] * max(1, (len(body) - 1) // 2) + "。"


def test_masks_and_padding(spark):
    ids = lambda n: F.array_repeat(F.lit(7), n)
    row = spark.range(1).select(G.masked_example(ids(5), ids(4), 32).alias("e"), G.masked_example(ids(40), ids(40), 32).alias("long")).first()
    assert row["e"]["mask"] == [0] * 5 + [1] * 4 and len(row["long"]["ids"]) == 32 == len(row["long"]["mask"])
    rows = spark.createDataFrame([(0, 0, [1, 2], [0, 1]), (0, 1, [1, 2, 3], [0, 1, 1])], "batch int, r int, ids array<int>, mask array<int>")
    padded = {r["r"]: r for r in G.padded_batches(rows, "batch", "r").collect()}
    assert padded[0]["ids"] == [1, 2, 0] and padded[0]["last_idx"] == 1 and padded[1]["mask"] == [0, 1, 1]


# ---- preferences and policies ----------------------------------------------

def scores(spark, rows):
    return spark.createDataFrame(rows, "model string, pair_id int, side string, logp double, n_tokens bigint")


def test_preference_losses(spark):
    same = scores(spark, [(m, 0, s, v, 1) for m in ("policy", "reference") for s, v in (("chosen", -3.0), ("rejected", -5.0))])
    row = H.logistic_preference_loss(H.log_ratio_margins(same)).first()
    assert row["loss"] == pytest.approx(math.log(2)) and row["margin"] == 0 and row["accuracy"] == 0
    margins = spark.createDataFrame([(1.0,), (-1.0,)], "margin double")
    assert H.logistic_preference_loss(margins).first()["accuracy"] == 0.5
    at = lambda m: H.squared_preference_loss(spark.createDataFrame([(m,)], "margin double"), 0.1).first()["loss"]
    assert at(5.0) == pytest.approx(0) and at(50.0) > at(4.0)


def test_pairwise_reward(spark):
    row = lambda c, r: H.pairwise_reward_loss(spark.createDataFrame([(0, c, r)], "pair_id int, chosen double, rejected double")).first()
    assert row(1.0, 1.0)["loss"] == pytest.approx(math.log(2)) and row(1.0, 1.0)["accuracy"] == 0.0
    assert row(3.0, 1.0)["loss"] < math.log(2) and row(3.0, 1.0)["accuracy"] == 1.0
    assert row(-1000.0, 1000.0)["loss"] == pytest.approx(2000.0)


def test_response_tokens_exclude_prompt(spark):
    rows = [(0, pos, int(pos >= 5), -1.0) for pos in range(12)]
    row = H.sequence_logp(spark.createDataFrame(rows, "seq int, pos int, mask int, logp double"), ["seq"]).first()
    assert (row["n_tokens"], row["logp"]) == (7, -7.0)


def test_group_advantage(spark):
    df = spark.createDataFrame([(0, 3.0), (0, 1.0), (0, -1.0), (0, -3.0), (1, 2.0)], "prompt_id int, reward double")
    adv = [r["advantage"] for r in H.group_advantages(df).where("prompt_id = 0").collect()]
    mean = sum(adv) / 4
    assert mean == pytest.approx(0) and sum((a - mean) ** 2 for a in adv) / 3 == pytest.approx(1, abs=1e-5)
    assert H.group_advantages(df).where("prompt_id = 1").first()["advantage"] == 0.0


def test_clipped_surrogate(spark):
    df = lambda *r: spark.createDataFrame([(x, 1.0, 1) for x in r], "ratio double, advantage double, mask int")
    clipped, free = H.clipped_surrogate(df(2.0)).first(), H.clipped_surrogate(df(2.0), 0).first()
    assert clipped["clip_frac"] == 1 and clipped["loss"] > free["loss"] == -2.0
    assert H.clipped_surrogate(df(1.05, 0.97)).first()["clip_frac"] == 0


def test_repetition_and_diversity(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b"],), (["x"],), (["a", "b", "c"],)], "tokens array<string>")
    row = H.repetition(df).first()
    assert row["repetition"] == pytest.approx((1 / 3 + 0) / 2) and row["outputs"] == 2
    assert H.diversity(spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "output string")).first()["diversity"] == 0.75


def truncated(logits, temperature, top_k, top_p, min_p):
    z = {t: v / temperature for t, v in logits.items()}
    if top_k:
        edge = sorted(z.values(), reverse=True)[:top_k][-1]
        z = {t: v for t, v in z.items() if v >= edge}
    soft = lambda d: {t: math.exp(v) / sum(map(math.exp, d.values())) for t, v in d.items()}
    if top_p:
        total, kept = 0.0, {}
        for t, p in sorted(soft(z).items(), key=lambda kv: (-kv[1], kv[0])):
            if total > top_p:
                break
            kept[t] = z[t]
            total += p
        z = kept
    if min_p:
        p = soft(z)
        z = {t: v for t, v in z.items() if p[t] >= min_p * max(p.values())}
    return soft(z)


@pytest.mark.parametrize("options", [(1.0, 3, None, None), (0.7, None, 0.8, None), (1.3, None, None, 0.2), (0.9, 6, 0.85, 0.1)])
def test_candidate_truncation(spark, options):
    rng = random.Random(4)
    logits = {f"t{i}": rng.choice([1.0, 2.0, rng.uniform(-2, 3)]) for i in range(12)}
    df = spark.createDataFrame([(0, t, v) for t, v in logits.items()], "g int, token string, logit double")
    got = {r["token"]: r["p"] for r in H.truncate_candidates(df, ["g"], "token", *options).collect()}
    assert got == pytest.approx(truncated(logits, *options))


def test_seed_significance(spark):
    rows = [("base", s, v) for s, v in enumerate([2.0, 2.1, 1.9])] + [("better", s, v) for s, v in enumerate([1.0, 1.1, 0.9])] + [("one", 0, 2.05)]
    summary = H.seed_summary(spark.createDataFrame(rows, "config string, seed int, best_val double"))
    assert {r["config"]: r["std"] for r in summary.collect()}["one"] == 0.0
    verdicts = {r["config"]: r["verdict"] for r in H.significance(summary, "base").collect()}
    assert verdicts == {"better": "real", "one": "noise"}


# ---- drift -----------------------------------------------------------------

def test_character_drift(spark):
    base = D.baseline_counts(table(spark, ["abcabcabc " * 20])).persist()
    buckets = D.baseline_buckets(base)
    same, other = S.char_counts(table(spark, ["abc cab"] * 30)), S.char_counts(table(spark, ["xyz9 zyx"] * 30))
    psi = lambda live: D.character_psi(buckets, live).first()["psi"]
    assert psi(same) < psi(other)
    report = D.drift_report(F.lit(30), buckets, base, other).first()
    assert report["oov_rate"] > 0 and report["level"] == "severe" and report["retrain_suggested"]
    assert D.drift_report(F.lit(0), buckets, base, same.where("false")).first()["psi"] == 0.0


def test_baseline_is_cut_at_the_sample(spark):
    counts = {r["ch"]: r["n"] for r in D.baseline_counts(table(spark, ["aaa", "bbbb", "cc"]), sample=7).collect()}
    assert counts == {"a": 3, "\n": 2, "b": 2}


def test_numeric_drift(spark):
    rng = random.Random(7)
    rows = [("ref", rng.gauss(25, 6)) for _ in range(2000)] + [("same", rng.gauss(25, 6)) for _ in range(2000)] + [("far", rng.gauss(35, 8)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "side string, v double")
    edges = [float(e) for e in range(0, 65, 5)] + [1e9]
    psi = lambda live: D.numeric_psi(df, "v", edges, "side", "ref", live).first()["psi"]
    assert psi("same") < 0.1 and psi("far") > 0.25


# ---- ledger ----------------------------------------------------------------

def ledger(spark, rows):
    return spark.createDataFrame(
        [(f"sha256:{d}", d, s, f"t{i}", {"test_loss": l}, {"data_quality_gate": g, "code_commit": "c"}) for i, (d, s, l, g) in enumerate(rows)],
        "model_digest string, short string, status string, created_at string, metrics struct<test_loss:double>, lineage struct<data_quality_gate:boolean, code_commit:string>")


def test_gate_reasons(spark):
    table_ = ledger(spark, [("prod", "production", 3.7, True), ("none", "registered", None, None), ("worse", "registered", 4.8, True), ("good", "registered", 3.5, True), ("edge", "registered", 3.74, True)])
    got = {r["short"]: len(r["reasons"]) for r in J.with_gate(table_).collect()}
    assert got == {"prod": 0, "none": 2, "worse": 1, "good": 0, "edge": 0}


def test_promotion_moves_exactly_one_model(spark):
    table_ = ledger(spark, [("aaa1", "production", 3.7, True), ("bbb2", "registered", 3.5, True), ("ccc3", "registered", 9.9, True)])
    status = lambda short: {r["short"]: r["status"] for r in J.promote(table_, short).collect()}
    assert status("bb") == {"aaa1": "archived", "bbb2": "production", "ccc3": "registered"}
    assert status("ccc") == status("zzz") == {"aaa1": "production", "bbb2": "registered", "ccc3": "registered"}


def test_register_is_idempotent(spark):
    a = ledger(spark, [("x", "production", 3.0, True)])
    b = ledger(spark, [("x", "registered", 1.0, True), ("y", "registered", 2.0, True), ("y", "registered", 2.0, True)])
    rows = J.register(J.register(a, b), b).orderBy("short").collect()
    assert [(r["short"], r["status"]) for r in rows] == [("x", "production"), ("y", "registered")]


# ---- telemetry -------------------------------------------------------------

def test_histogram_quantile(spark):
    df = spark.createDataFrame([(v,) for v in [0.02] * 50 + [0.2] * 40 + [30.0] * 10], "v double")
    histogram = K.bucket_counts(df, "v", K.LATENCY_BORDERS)
    assert K.histogram_quantile(histogram, 0.5).first()["quantile"] == pytest.approx(0.025)
    assert K.histogram_quantile(histogram, 0.7).first()["quantile"] == pytest.approx(0.1 + 0.15 * 20 / 40)
    assert K.histogram_quantile(histogram, 0.95).first()["quantile"] == 10.0


def test_cold_start(spark):
    rows = [(i, i, 354.0 if i == 0 else 50.0 + i) for i in range(30)]
    row = K.cold_start(spark.createDataFrame(rows, "event_id int, ts int, latency double")).first()
    warm = sorted(50.0 + i for i in range(1, 30))
    assert (row["cold"], row["p50"], row["p95"]) == (354.0, warm[int(0.5 * 29)], warm[min(28, int(0.95 * 29))])


def test_rollout_only_the_gate_decides(spark):
    df = spark.createDataFrame([([], 0.5, 2.0, 1.0, 0.9), (["bad"], 1.0, 1.0, 1.0, 0.0)], "reasons array<string>, agreement double, canary_p95 double, production_p95 double, psi double")
    rows = K.rollout_decision(df).collect()
    assert [r["decision"] for r in rows] == ["release", "hold"] and len(rows[0]["advice"]) == 3 and rows[1]["advice"] == []
