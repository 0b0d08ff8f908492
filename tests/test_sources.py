import os

import pytest
from pyspark.sql import functions as F

from textloom.operators import runs
from textloom.plans import corpus as P
from textloom.plans.corpus import CorpusConfig
from textloom.sources import readers as R
from textloom.sources import writers as W

SENTENCES = [
    "A river runs past the old mill and turns its wooden wheel all day long.",
    "編譯器把原始碼轉成機器指令 so that a processor can run it directly.",
    "Memory pages are mapped lazily, which is why the first access is slower.",
    "測試 data should be small, readable and easy to check by hand every time.",
    "Queues smooth out bursts of work when producers are faster than consumers.",
]
LONG = (
    "Sorting large tables needs more memory than one machine has, so the rows are split by key into ranges. Each range is sorted alone and "
    "the ranges are read one after another. The split points come from a sample, because a full count of all keys would cost as much as the "
    "sort itself. When a single key is very frequent its range grows, and the work has to be shared in some other way to keep every task short."
)


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    """Thirteen files whose fate at every stage is known."""
    folder = tmp_path_factory.mktemp("golden")
    files = {f"good_{i}": s for i, s in enumerate(SENTENCES)}
    files["dup_exact"] = SENTENCES[0].replace("old mill", "old   mill")
    files["near_a"] = LONG
    files["near_b"] = "Copied. " + LONG.replace("a full count", "one full count").replace("very frequent", "quite frequent")
    files["html"] = "<div class='x'><p>Tags around</p> a <b>perfectly</b> ordinary sentence of words.</div>"
    files["ctrl"] = "Bytes\x00\x07 inside\x1f this line were put there by a broken export tool."
    files["short"], files["repeat"], files["symbols"] = "ok", "z" * 200, "#@$%^&*!" * 8
    for name, text in files.items():
        (folder / f"{name}.txt").write_text(text, encoding="utf-8")
    (folder / "ignored.md").write_text("not a text file", encoding="utf-8")
    return R.read_folder(spark, str(folder))


def test_folder_order(golden):
    rows = golden.orderBy("doc_id").collect()
    assert [os.path.basename(r["source"])[:-4] for r in rows] == [
        "ctrl", "dup_exact", "good_0", "good_1", "good_2", "good_3", "good_4", "html", "near_a", "near_b", "repeat", "short", "symbols"]
    assert [r["doc_id"] for r in rows] == list(range(13))


def test_golden_corpus_counts(golden):
    prepared = P.prepare_corpus(golden)
    rows = {r["stage"]: r for r in P.stage_report(prepared).collect()}
    assert (rows["quality"]["n_in"], rows["quality"]["dropped"]) == (13, 3)
    assert rows["quality"]["reasons"] == {"too_short": 1, "too_repetitive": 1, "too_many_symbols": 1}
    assert rows["exact_dedup"]["dropped"] == 1 and rows["near_dedup"]["dropped"] == 1 and rows["near_dedup"]["n_out"] == 8
    left = prepared.survivors.orderBy("doc_id").collect()
    names = [os.path.basename(r["source"])[:-4] for r in left]
    assert names == ["ctrl", "dup_exact", "good_1", "good_2", "good_3", "good_4", "html", "near_a"]
    assert not any("<" in r["text"] or "\x00" in r["text"] for r in left)
    meta = P.corpus_meta(prepared.survivors, F.lit(13)).first()
    whole = "\n\n".join(r["text"] for r in left)
    assert (meta["total_chars"], meta["vocab_size"], meta["docs_out"], meta["token_dtype"]) == (len(whole), len(set(whole)), 8, "uint16")
    assert meta["val_tokens"] == meta["test_tokens"] == int(len(whole) * 0.1)


def test_dedup_can_be_switched_off(golden):
    prepared = P.prepare_corpus(golden, cfg=CorpusConfig(dedup=False))
    assert prepared.survivors.count() == 10


@pytest.mark.parametrize("content", ["a<|doc|>b<|doc|>c", "a<|doc|>b<|doc|>", "", "<|doc|>", "one\ntwo", "a<|doc|><|doc|>b"])
def test_delimited_scan_matches_string_split(spark, tmp_path, content):
    path = tmp_path / "docs.txt"
    path.write_text(content, encoding="utf-8")
    rows = R.read_delimited(spark, str(path), "<|doc|>").orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == content.split("<|doc|>")
    assert all(r["source"].endswith(f"docs.txt#{r['doc_id']}") for r in rows)


def test_whole_file_is_one_document(spark, tmp_path):
    path = tmp_path / "one.txt"
    path.write_text("x\n\ny", encoding="utf-8")
    assert [r["text"] for r in R.read_delimited(spark, str(path)).collect()] == ["x\n\ny"]


def test_bad_bytes_are_replaced(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"ok \xff end")
    assert R.read_folder(spark, str(tmp_path)).first()["text"] == "ok � end"


def test_run_log(spark, tmp_path):
    (tmp_path / "base.csv").write_text("step,train_loss,val_loss\n0,4.3,4.2\n200,2.7,2.8\n")
    log = R.read_run_logs(spark, str(tmp_path))
    assert [(r["run"], r["step"], r["val_loss"]) for r in log.orderBy("step").collect()] == [("base", 0, 4.2), ("base", 200, 2.8)]
    summary = runs.run_summary(log).first()
    assert summary["best_val"] == 2.8 and summary["final_gap"] == pytest.approx(0.1)


def test_merged_text_is_in_order(spark, tmp_path, golden):
    path = str(tmp_path / "merged")
    W.write_merged_text(golden.where("doc_id between 3 and 6"), path)
    parts = sorted(p for p in os.listdir(path) if p.startswith("part"))
    body = "".join(open(f"{path}/{p}", encoding="utf-8").read() for p in parts)
    assert body == "\n\n".join(SENTENCES[1:]) + "\n"
    assert [r["text"] for r in R.read_lines(spark, path).orderBy("ordinal").collect()] == body.split("\n")[:-1]
