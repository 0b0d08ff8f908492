"""Language identification by nearest centroid over TF-IDF vectors of byte n-grams.

Letters count, everything else is a word gap.  Document frequencies come from
all rows.  From each language at most ``PER_LANGUAGE`` rows (those with the
smallest hash of the id) are clustered into ``CLUSTERS`` centroids by spherical
k-means, one language a task.  A text gets the language of the most similar
centroid.  It is ``rejected`` when it lies farther from that centroid than
``REACH`` times the largest distance at which the language's own sample lies;
callers who want no guess there read that column.

What is broadcast has CLUSTERS * DIMS floats for each language.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import hash_sample, held_out, per_batch, stored
from textloom.llm.vectors import dense, document_frequencies, hashed, inverse, unit, weigh

DIMS = 8192
WIDEST = 4
PER_LANGUAGE = 400
CLUSTERS = 3
REACH = 1.1
SLACK = 1e-3  # a sample of equal texts has no extent
UNKNOWN = "und"
_BLOCK = 256
_PART = 1 << 20

#: Every ASCII byte but letters is a gap; other bytes belong to letters of some script.
GAPS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def letter_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(GAPS).split())
    total = np.zeros(DIMS, dtype=np.int64)
    for start in range(0, len(raw), _PART):  # long texts in parts, to bound memory
        form = np.frombuffer(raw[start : start + _PART], dtype=np.uint8).astype(np.uint64)
        key = np.zeros(form.size, dtype=np.uint64)
        for width in range(1, min(WIDEST, form.size) + 1):
            key = (key[: form.size - width + 1] << np.uint64(8)) | form[width - 1 :]
            total += np.bincount(hashed(key + np.uint64(width << 40), DIMS).astype(np.int64), minlength=DIMS)
    found = np.flatnonzero(total)
    return found, total[found]


def clusters(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit rows; starts from rows far apart, so the result depends on nothing random."""
    k = min(k, rows.shape[0])
    picked = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(picked) < k:
        picked.append(int(np.argmin((rows @ rows[picked].T).max(axis=1))))
    centres = rows[picked]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        centres = unit(np.stack([rows[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(k)]))
    return centres


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = CLUSTERS) -> dict:
    """Model from (doc_id, text, lang): idf and the centroids, the most frequent language first."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    n_rows, seen = document_frequencies(usable.select("doc_id", "text"), letter_terms, DIMS)
    idf = inverse(n_rows, seen)
    ids, sizes = hash_sample(usable.select("doc_id", "lang"), "lang", per_language)
    picked = stored(ids, "sample").distinct()
    sample = usable.join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", "text")

    def vectors(batch: pa.RecordBatch) -> dict:
        terms = [letter_terms(t) for t in batch.column("text").to_pylist()]
        return {"lang": batch.column("lang"), "terms": [n.astype(np.int32) for n, _ in terms], "weights": [weigh(n, c, idf) for n, c in terms]}

    def centroids(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.zeros((len(frame), DIMS), dtype=np.float32)
        for row, n, w in zip(rows, frame["terms"], frame["weights"]):
            row[n] = w
        rows = rows[np.lexsort(rows[:, ::64].T)]  # the same order whichever way the rows came
        centres = clusters(rows, k)
        reach = float((1 - (rows @ centres.T).max(axis=1)).max())
        return pd.DataFrame({"lang": key[0], "rows": len(frame), "reach": reach, "centre": [c.tolist() for c in centres]})

    sparse = per_batch(sample, vectors, "lang string, terms array<int>, weights array<float>")
    got = sparse.groupBy("lang").applyInPandas(centroids, "lang string, rows bigint, reach double, centre array<float>").toPandas()
    got["size"] = got["lang"].map(sizes)
    got = got.sort_values(["size", "lang"], ascending=[False, True], kind="stable")
    centres = np.array(got["centre"].tolist(), dtype=np.float32).reshape(len(got), DIMS)
    return {"idf": idf, "centres": centres, "lang": got["lang"].tolist(), "reach": got["reach"].to_numpy(dtype=np.float64)}


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = CLUSTERS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) per row.

    ``docs`` has doc_id, text and lang; lang is read only where the row is not
    held out, to learn.  lang_pred is a learned language, or ``und`` for null
    texts and texts without a letter, and if nothing could be learned; score is
    the cosine with the nearest centroid (0 for ``und``).  A text that shares
    no weighted n-gram with any centroid gets the most frequent language with
    score 0 and is rejected.  Rows of equal text score alike, repeated rows
    each get a row, an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(own, per_language, k))

    def score(batch: pa.RecordBatch) -> dict:
        m, near = model.value, []
        for start in range(0, batch.num_rows if m["lang"] else 0, _BLOCK):
            part = batch.slice(start, _BLOCK).column("text").to_pylist()
            near.append(dense(part, letter_terms, m["idf"], DIMS) @ m["centres"].T)
        if not near:
            return {"doc_id": batch.column("doc_id"), "lang_pred": [UNKNOWN] * batch.num_rows, "score": np.zeros(batch.num_rows), "rejected": [True] * batch.num_rows}
        near = np.concatenate(near).astype(np.float64)
        best = near.argmax(axis=1)
        top = near[np.arange(best.size), best].clip(0, 1)
        lettered = np.array(batch.column("lettered").to_pylist(), dtype=bool)
        return {
            "doc_id": batch.column("doc_id"), "lang_pred": [m["lang"][b] if ok else UNKNOWN for b, ok in zip(best, lettered)],
            "score": np.where(lettered, top, 0.0), "rejected": ~lettered | (1 - top > REACH * m["reach"][best] + SLACK),
        }

    rows = own.select("doc_id", "text", F.col("text").rlike(r"\p{L}").alias("lettered"))
    scored = per_batch(rows, score, "doc_id bigint, lang_pred string, score double, rejected boolean")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
