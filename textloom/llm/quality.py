"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Terms describe the form of a text: n-grams over character classes (runs of
letters and digits count once, punctuation stands for itself), and how often a
word or a line repeats the one before.  Their TF-IDF weights use document
frequencies of all rows.  A truncated singular value decomposition of a bounded
sample of labelled rows (at most ``PER_CLASS`` of each label, those with the
smallest hash of the id) gives the latent space.  The labelled vectors are
broadcast (2 * PER_CLASS rows of ``RANK`` floats); every document is compared
with all of them, in blocks, and the ``NEIGHBOURS`` most similar vote with
their similarity.  Votes are scaled so that the classes weigh as in all
labelled rows, not as in the sample.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import hash_sample, held_out, per_batch, stored, texts
from textloom.llm.vectors import counted, dense, document_frequencies, hashed, inverse, unit, weigh

DIMS = 4096
WIDTHS = (1, 2, 3, 4, 5)
PER_CLASS = 2000
RANK = 48
NEIGHBOURS = 15
THRESHOLD = 0.7
REPEATS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
_BLOCK = 512
_PART = 1 << 20


def _classes() -> np.ndarray:
    """Byte -> class: a letter, A capital, 0 digit, blank, line end; other ASCII characters are their own."""
    table = np.arange(256, dtype=np.uint8)
    table[:32] = table[127] = ord(" ")
    table[10] = 10
    table[ord("a") : ord("z") + 1] = table[128:] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    return table


CLASSES = _classes()
RUNS = np.isin(np.arange(256), [ord(c) for c in "aA0 \n"])  # classes of which a run counts once


def form_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = text.encode("utf-8", "surrogatepass")
    total = None
    for start in range(0, max(len(raw), 1), _PART):  # long texts in parts, to bound memory
        form = CLASSES[np.frombuffer(raw[start : start + _PART], dtype=np.uint8)]
        form = form[np.r_[True, (form[1:] != form[:-1]) | ~RUNS[form[1:]]]] if form.size else form
        form = form.astype(np.uint64) + np.uint64(1)
        grams, key = [], np.zeros(form.size, dtype=np.uint64)
        for width in range(1, max(WIDTHS) + 1):
            key = key[: form.size - width + 1] * np.uint64(257) + form[width - 1 :] if form.size >= width else key[:0]
            if width in WIDTHS:
                grams.append(hashed(key + np.uint64(width << 56), DIMS))
        counts = np.bincount(np.concatenate(grams).astype(np.int64), minlength=DIMS)
        total = counts if total is None else total + counts
    words, lines = raw.split(), raw.split(b"\n")
    again = [(sum(map(eq, v[1:], v)), len(v)) for v in (words, lines)]
    # a repetition counts under every share that it reaches
    total = np.r_[total, [n if n > share * size else 0 for n, size in again for share in REPEATS]]
    found = np.flatnonzero(total)
    return found, total[found]


TERMS = DIMS + 2 * len(REPEATS)


def learning_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label): a bounded, reproducible sample of the rows to learn from, and the classes' sizes."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = docs.select("doc_id").distinct()
    marks = stored(marks.join(ids, "doc_id", "left_semi"), "marks")
    picked, sizes = hash_sample(marks, "label", per_class)
    return docs.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]), sizes


def latent_space(rows: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors of the largest ``rank`` singular values, by randomised subspace iteration."""
    rank = max(1, min(rank, *rows.shape))
    basis = np.random.default_rng(seed).standard_normal((rows.shape[1], min(rank + 8, *rows.shape))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ right.T)[:, :rank].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, rank: int = RANK) -> dict:
    """Model of bounded size: idf, projection, labelled vectors with their votes, and the prior."""
    n_rows, seen = document_frequencies(docs, form_terms, TERMS)
    idf = inverse(n_rows, seen)
    sample, sizes = learning_sample(docs, labels, label, per_class)

    def vectors(batch: pa.RecordBatch) -> dict:
        terms = [form_terms(t) for t in batch.column("text").to_pylist()]
        return {
            "doc_id": batch.column("doc_id"), "label": batch.column("label"),
            "terms": [n.astype(np.int32) for n, _ in terms], "weights": [weigh(n, c, idf) for n, c in terms],
        }

    got = per_batch(sample, vectors, "doc_id bigint, label int, terms array<int>, weights array<float>").toPandas().sort_values("doc_id")
    rows = np.zeros((len(got), TERMS), dtype=np.float32)
    for row, n, w in zip(rows, got["terms"], got["weights"]):
        row[n] = w
    y = got["label"].to_numpy(dtype=np.float32)
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    if not len(got):
        return {"idf": idf, "projection": np.zeros((TERMS, 1), np.float32), "points": np.zeros((1, 1), np.float32), "y": np.zeros(1, np.float32), "vote": np.zeros(1, np.float32), "prior": prior}
    projection = latent_space(rows, rank)
    vote = np.array([sizes[int(v)] / (y == v).sum() for v in y], dtype=np.float32)
    return {"idf": idf, "projection": projection, "points": unit(rows @ projection), "y": y, "vote": vote / vote.max(), "prior": prior}


def vote(points: np.ndarray, model: dict, neighbours: int) -> np.ndarray:
    """Scores of unit vectors: exact cosines with every labelled vector, in blocks."""
    k = min(neighbours, model["y"].size)
    out = np.empty(points.shape[0])
    for start in range(0, points.shape[0], _BLOCK):
        near = points[start : start + _BLOCK] @ model["points"].T
        top = np.argpartition(near, -k, axis=1)[:, -k:]
        weight = np.take_along_axis(near, top, axis=1).clip(0).astype(np.float64) ** 4 * model["vote"][top]
        total = weight.sum(axis=1)
        score = (weight * model["y"][top]).sum(axis=1)
        out[start : start + _BLOCK] = np.divide(score, total, out=np.full(total.size, model["prior"]), where=total > 0)
    return out.clip(0, 1)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, per_class: int = PER_CLASS, rank: int = RANK, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row.

    Learns only from labelled rows that are not held out; a document labelled
    twice counts once, as 1 if any of its labels is.  Null text counts as
    empty; texts that share no weighted term with the sample score the share of
    label 1.  Without labelled rows of one or both classes every score follows
    from what there is (0.5 for none).  Rows with equal text score alike,
    repeated rows each get a row, and an empty table gives an empty result.
    """
    docs = texts(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, per_class, rank))

    def score(batch: pa.RecordBatch) -> dict:
        m = model.value
        points = np.concatenate([
            dense(batch.slice(i, _BLOCK).column("text").to_pylist(), form_terms, m["idf"], TERMS) @ m["projection"]
            for i in range(0, batch.num_rows, _BLOCK)
        ]) if batch.num_rows else np.zeros((0, m["projection"].shape[1]), np.float32)
        return {"doc_id": batch.column("doc_id"), "score": vote(unit(points), m, neighbours)}

    scored = per_batch(docs, score, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
