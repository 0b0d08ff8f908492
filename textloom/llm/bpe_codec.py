"""Byte-level BPE: encode whole texts to token ids and decode ids to bytes.

The merges come from a local rank file, read once on the driver and broadcast
(a vocabulary, 50,000 entries).  Long texts are cut before they reach the
encoder, only where no match of the pattern can reach across: between a
character that is not white space and one that is.  Every alternative of the
pattern either is a run of white space or ends before the next white space, so
the matches on either side stay the same.  A stretch without such a place
stays in one piece.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import per_batch, texts

PIECE = 100_000
_BOUNDARY = regex.compile(r"(?<=\S)(?=\s)")


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pieces(text: str, most: int = PIECE) -> list[str]:
    """The text cut at safe places, each piece about ``most`` characters where the text has such places."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while len(text) - start > most:
        found = _BOUNDARY.search(text, start + most)
        if found is None:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


def make_encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(encoding, text: str, most: int = PIECE) -> list[int]:
    if len(text) <= most:
        return encoding.encode_ordinary(text)
    return [i for piece in pieces(text, most) for i in encoding.encode_ordinary(piece)]


def _with_encoding(df: DataFrame, ranks: dict[bytes, int], pattern: str, make, schema: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    held = []

    def run(batch: pa.RecordBatch) -> dict:
        if not held:  # once per task
            held.append(make_encoding(shared.value, pattern))
        return make(held[0], batch)

    return per_batch(df, run, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = PIECE) -> DataFrame:
    """(doc_id, ids array<int>) per row; null text is empty and has no ids.  Rows and ties stay as they are."""

    def make(encoding, batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "ids": [encode_text(encoding, t, most) for t in batch.column("text").to_pylist()]}

    return _with_encoding(texts(docs), ranks, pattern, make, "doc_id bigint, ids array<int>")


def decode(coded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, bytes binary): the raw bytes of the ids, which need not be whole characters; null ids give none."""

    def make(encoding, batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "bytes": [encoding.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]}

    return _with_encoding(coded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), ranks, pattern, make, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = PIECE) -> DataFrame:
    """Encode and decode in one pass over the texts: counts and digests, and whether the bytes came back.

    One row per input row.  Null text counts as empty: no tokens, digests of
    the empty string.  An empty table gives an empty result.
    """

    def make(encoding, batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "same": []}
        for text in batch.column("text").to_pylist():
            ids = encode_text(encoding, text, most)
            raw = encoding.decode_bytes(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
            out["same"].append(raw == text.encode())
        return out

    return _with_encoding(
        texts(docs), ranks, pattern, make,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, same boolean",
    )
