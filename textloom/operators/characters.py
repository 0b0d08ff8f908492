"""Mergeable character summaries: how often each character occurs and where it is first seen.

A task turns its texts into code points, counts them by place in a table, and
sends one row per distinct character; a small aggregate merges the rows of all
tasks.  No character ever is a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from textloom.functions.vectorized import code_points

#: Characters of this many bytes of text are counted at a time.
SLICE_BYTES = 8 << 20
#: Code points below this are counted by place, the rare ones above by sorting.
TABLE = 1 << 16


def point_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, count, first place) of the distinct code points of a stream."""
    common = np.flatnonzero(points < TABLE) if points.size and int(points.max()) >= TABLE else None
    low = points if common is None else points[common]
    counts = np.bincount(low, minlength=1)
    first = np.empty(counts.size, np.int64)
    first[low[::-1]] = np.arange(low.size - 1, -1, -1)  # of equal places the last one written, the first in the stream, stays
    codes = np.flatnonzero(counts)
    if common is None:
        return codes, counts[codes], first[codes]
    rest = np.flatnonzero(points >= TABLE)
    high, at, n = np.unique(points[rest], return_index=True, return_counts=True)
    return np.concatenate([codes, high]), np.concatenate([counts[codes], n]), np.concatenate([common[first[codes]], rest[at]])


def merge_slice(held: dict, keys: list, texts: list[str]) -> None:
    """Add some texts to ``held``: code point -> [count, (key is known, key), position in the text]."""
    rows = sorted((i for i, t in enumerate(texts) if t), key=lambda i: (keys[i] is not None, keys[i]) if keys[i] is not None else (False,))
    if not rows:
        return
    streams = [code_points(texts[i]) for i in rows]
    starts = np.cumsum([0, *map(len, streams)])
    codes, counts, first = point_counts(np.concatenate(streams))
    owner = np.searchsorted(starts, first, side="right") - 1
    for code, n, row, at in zip(codes.tolist(), counts.tolist(), owner.tolist(), (first - starts[owner]).tolist()):
        key = keys[rows[row]]
        place = ((True, key) if key is not None else (False,), at)
        known = held.get(code)
        if known is None:
            held[code] = [n, place, key]
        else:
            known[0] += n
            if place < known[1]:
                known[1], known[2] = place, key


def character_summary(texts: DataFrame, key: str = "doc_id", text: str = "unit") -> DataFrame:
    """(ch, n, first_at): count of each character, and the smallest (key, position from 0) at which it stands.

    Null and empty texts have no characters; a null key comes before all
    others, as in Spark's order.  Characters are code points.
    """
    schema = S.StructType([S.StructField("ch", S.StringType()), S.StructField("n", S.LongType()), S.StructField(key, texts.schema[key].dataType), S.StructField("at", S.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        held: dict = {}
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                merge_slice(held, part.column(0).to_pylist(), part.column(1).to_pylist())
        if held:
            target = to_arrow_schema(schema)
            columns = [[chr(c) for c in held], [v[0] for v in held.values()], [v[2] for v in held.values()], [v[1][1] for v in held.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

    partial = texts.select(key, text).mapInArrow(run, schema)
    return partial.groupBy("ch").agg(F.sum("n").alias("n"), F.min(F.struct(key, "at")).alias("first_at"))


def character_totals(texts: DataFrame, text: str = "text") -> DataFrame:
    """(ch, n) over all texts."""
    return character_summary(texts.select(F.lit(0).alias("_key"), F.col(text).alias("_text")), "_key", "_text").select("ch", "n")
