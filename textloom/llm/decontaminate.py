"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over word places; the masked-out places are ignored, so
a seed still hits where those words were replaced.  Seeds of the documents that
pass a Bloom filter of the benchmark's seeds (64 bits a seed, bounded) are
joined with the benchmark's seeds.  Around every hit the document and the item
are laid along the hit's diagonal, and the longest stretch in which at least
``SHARE`` of the words agree is the overlap.  It counts from ``WORDS`` words on,
or over the whole item where that is shorter.

The texts are read once and never shuffle: only word hashes of documents with a
hit do.  The filter's size is checked; a larger benchmark fills it more, which
costs rows to the join but never a hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import per_batch, stored, texts
from textloom.llm.words import spaced_hashes, word_hashes

MASKS = ("11111", "110111", "1101011", "11010011")
WORDS = 13
SHARE = 0.8
SEED_BITS = 64
MOST_BITS = 1 << 30
PROBES = 4
SCHEMA = "doc_id bigint, item_id bigint, doc_start int, item_start int, n_words int, n_same int"


def seed_hashes(words: np.ndarray, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every seed of a text."""
    hashes = [spaced_hashes(words, m) for m in masks]
    return np.concatenate(hashes), np.concatenate([np.arange(h.size) for h in hashes])


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, words) of the benchmark; repeated items count once."""

    def make(batch: pa.RecordBatch) -> dict:
        return {"item_id": batch.column("doc_id"), "words": [word_hashes(t).view(np.int64) for t in batch.column("text").to_pylist()]}

    return per_batch(texts(benchmark, "item_id"), make, "item_id bigint, words array<bigint>").distinct()


def item_seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(seed, item_id, at): each seed of each item."""

    def make(batch: pa.RecordBatch) -> dict:
        seeds, owner, at = [], [], []
        for item, words in zip(batch.column("item_id").to_pylist(), batch.column("words").to_pylist()):
            h, start = seed_hashes(np.array(words, dtype=np.int64).view(np.uint64), masks)
            seeds.append(h.view(np.int64))
            at.append(start)
            owner += [item] * h.size
        return {"seed": np.concatenate(seeds), "item_id": owner, "at": np.concatenate(at).astype(np.int32)} if seeds else None

    return per_batch(items, make, "seed bigint, item_id bigint, at int")


def _probe(seeds: np.ndarray, number: int, bits: int) -> np.ndarray:
    step = (seeds >> np.uint64(32)) | np.uint64(1)
    return ((seeds + np.uint64(number) * step) & np.uint64(bits - 1)).astype(np.int64)


def seed_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of the distinct seeds as 32-bit words; the driver gets at most ``bits / 32`` rows."""

    def make(batch: pa.RecordBatch) -> dict:
        seeds = batch.column("seed").to_numpy().view(np.uint64)
        at = np.concatenate([_probe(seeds, i, bits) for i in range(PROBES)])
        return {"word": at >> 5, "bit": np.left_shift(1, at & 31)}

    words = per_batch(seeds.select("seed").distinct(), make, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(max(1, bits >> 5), dtype=np.uint32)
    rows = words.toPandas()
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def filter_bits(n_seeds: int) -> int:
    return min(MOST_BITS, 1 << max(10, (n_seeds * SEED_BITS - 1).bit_length()))


def document_hits(docs: DataFrame, bloom: np.ndarray, masks: tuple[str, ...]) -> DataFrame:
    """(doc_id, words, hits): documents with a seed that passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)
    bits = bloom.size << 5

    def make(batch: pa.RecordBatch) -> dict | None:
        out: dict = {"doc_id": [], "words": [], "seeds": [], "at": []}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            words = word_hashes(text)
            seeds, at = seed_hashes(words, masks)
            for i in range(PROBES):
                place = _probe(seeds, i, bits)
                hit = shared.value[place >> 5] >> (place & 31).astype(np.uint32) & 1 == 1
                seeds, at = seeds[hit], at[hit]
            if seeds.size:
                out["doc_id"].append(doc)
                out["words"].append(words.view(np.int64))
                out["seeds"].append(seeds.view(np.int64))
                out["at"].append(at.astype(np.int32))
        return out if out["doc_id"] else None

    return per_batch(texts(docs), make, "doc_id bigint, words array<bigint>, seeds array<bigint>, at array<int>")


def longest_agreeing(same: np.ndarray, share: float = SHARE) -> tuple[int, int]:
    """The longest stretch of places of which at least ``share`` agree, first and last place agreeing."""
    places = np.flatnonzero(same)
    if not places.size:
        return 0, 0
    # over agreeing places i <= j: (j - i + 1) >= share * (places[j] - places[i] + 1), both sides brought together per end
    rank = np.arange(places.size)
    tail = (rank + 1) - share * (places + 1)
    head = rank - share * places
    order = np.minimum.accumulate(head)
    best = (0, 0)
    for j in range(places.size - 1, -1, -1):
        if places[j] + 1 - places[0] <= best[1] - best[0]:
            break
        i = int(np.argmax(order[: j + 1] <= tail[j] + 1e-9))
        if order[i] <= tail[j] + 1e-9 and places[j] + 1 - places[i] > best[1] - best[0]:
            best = (int(places[i]), int(places[j]) + 1)
    return best


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """One row per document and item that share a passage: the longest overlap, in word places.

    ``share`` of the words along the overlap agree and it has ``words`` words,
    or as many as the item where that has fewer.  Items with fewer words than
    the shortest mask are never found.  Null and empty texts overlap nothing; a
    null doc_id is reported as null.  Repeated rows give their overlap once; of
    equally long overlaps the first in the document is named.  Empty tables
    give an empty result; further columns are ignored.
    """
    items = stored(item_words(benchmark), "items")
    seeds = stored(item_seeds(items, masks), "seeds")
    bloom = seed_filter(seeds, filter_bits(seeds.count()))
    found = stored(document_hits(docs, bloom, masks), "hits")
    hits = found.select("doc_id", F.explode(F.arrays_zip("seeds", "at")).alias("h")).select("doc_id", F.col("h.seeds").alias("seed"), F.col("h.at").alias("place"))
    laid = hits.join(seeds, "seed").select("doc_id", "item_id", (F.col("place") - F.col("at")).alias("shift")).distinct()
    laid = stored(laid, "laid").join(items.withColumnRenamed("words", "item"), "item_id")
    first = F.greatest(F.col("shift"), F.lit(0))
    doc = found.select(F.col("doc_id").alias("own_id"), "words")
    windows = laid.join(doc, laid["doc_id"].eqNullSafe(doc["own_id"])).select(
        "doc_id", "item_id", "shift", "item",
        F.slice("words", first + 1, F.greatest(F.col("shift") + F.size("item") - first, F.lit(0))).alias("window"),
    )

    def verify(batch: pa.RecordBatch) -> dict | None:
        out: dict = {n: [] for n in ("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same")}
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "shift")), batch.column("item"), batch.column("window"))
        for doc_id, item_id, shift, item, window in rows:
            a, b = item.values.to_numpy()[max(-shift, 0) :], window.values.to_numpy()
            size = min(a.size, b.size)
            same = a[:size] == b[:size]
            need = min(words, len(item))
            if same.sum() < share * need:
                continue
            start, end = longest_agreeing(same, share)
            if end - start >= need:
                out["doc_id"].append(doc_id)
                out["item_id"].append(item_id)
                out["doc_start"].append(max(shift, 0) + start)
                out["item_start"].append(max(-shift, 0) + start)
                out["n_words"].append(end - start)
                out["n_same"].append(int(same[start:end].sum()))
        return out if out["doc_id"] else None

    verified = per_batch(windows, verify, SCHEMA)
    best = F.max(F.struct(F.col("n_words"), F.col("n_same"), (-F.col("doc_start")).alias("before"), (-F.col("item_start")).alias("item_before"))).alias("best")
    return verified.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.before")).alias("doc_start"), (-F.col("best.item_before")).alias("item_start"), "best.n_words", "best.n_same",
    )
