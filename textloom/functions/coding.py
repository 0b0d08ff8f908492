"""Vectorized token coding: code point lookup and pair merging over whole Arrow batches."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from textloom.functions.vectorized import code_points, text_slices

BREAK = -1  # sits between two texts of a batch so that no pair spans them
SLICE_CHARS = 1 << 20  # characters or tokens worked on at a time


def lookup_table(chars: Sequence[str]) -> np.ndarray:
    """Code point -> token id (position in ``chars``); unknown ones and the last entry are -1."""
    table = np.full(max(map(ord, chars), default=0) + 2, BREAK, dtype=np.int32)
    for i, ch in enumerate(chars):
        table[ord(ch)] = i
    return table


def look_up(table: np.ndarray, text: str) -> np.ndarray:
    return table[np.minimum(code_points(text), table.size - 1)]


def pair_places(ids: np.ndarray, left: int, right: int) -> np.ndarray:
    """Where the pair starts, left to right, without overlaps."""
    hit = np.flatnonzero(ids[:-1] == left)
    hit = hit[ids[hit + 1] == right]
    if left == right and hit.size:
        # In a run of equal tokens every second position starts a merge.
        fresh = np.concatenate(([True], np.diff(hit) > 1))
        run_start = hit[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        hit = hit[(hit - run_start) % 2 == 0]
    return hit


def merge_pair(ids: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """Replace the pair everywhere, left to right, without overlaps."""
    hit = pair_places(ids, left, right)
    if hit.size == 0:
        return ids
    out = ids.copy()
    out[hit] = new
    keep = np.ones(ids.size, dtype=bool)
    keep[hit + 1] = False
    return out[keep]


class MergeRanks:
    """Merges by the rank in which they were learned, applied to a whole stream at once.

    The stream is a linked list of tokens.  Each place waits under the rank of
    the pair that starts there, and ranks are served in order; a merge makes new
    pairs at its own and the place before it alone, which wait in turn.  A pair
    with a merged token was learned after it, so no rank comes back.  The cost
    follows the length of the stream and the merges done in it, not the number
    of merges known.
    """

    def __init__(self, merges: Sequence[tuple[int, int, int]]):
        rules = np.array([tuple(m) for m in merges], dtype=np.int64).reshape(-1, 3)
        # of a pair that is there twice the first rank counts
        self.pairs, self.rank = np.unique((rules[:, 0] << 32) | rules[:, 1], return_index=True)
        self.left, self.right, self.new = rules.T

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        wanted = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), self.pairs.size - 1)
        return np.where((self.pairs[at] == wanted) & (left >= 0) & (right >= 0), self.rank[at], -1)

    def apply(self, ids: np.ndarray) -> np.ndarray:
        if ids.size < 2 or not self.pairs.size:
            return ids
        ids = np.append(ids, BREAK).astype(np.int32)  # the last place ends every stream
        end = ids.size - 1
        after, before = np.arange(1, ids.size + 1), np.arange(-1, ids.size - 1)
        alive = np.ones(ids.size, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def wait(places: np.ndarray) -> None:
            rank = self.ranks(ids[places], ids[after[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            by_rank = np.argsort(rank, kind="stable")
            found, first = np.unique(rank[by_rank], return_index=True)
            for r, part in zip(found.tolist(), np.split(places[by_rank], first[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(part)

        wait(np.arange(end))
        while order:
            r = heapq.heappop(order)
            left, right, new = self.left[r], self.right[r], self.new[r]
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (ids[at] == left)]
            at = at[ids[after[at]] == right]
            if left == right and at.size:
                # in a run of equal tokens every second place starts a merge
                fresh = np.r_[True, after[at[:-1]] != at[1:]]
                place = np.arange(at.size)
                at = at[(place - place[fresh][np.cumsum(fresh) - 1]) % 2 == 0]
            gone = after[at]
            ids[at] = new
            alive[gone] = False
            after[at] = after[gone]
            before[after[at]] = at
            near = np.r_[at, before[at]]
            wait(np.unique(near[near >= 0]))
        return ids[:end][alive[:end]]


def _as_lists(flat: np.ndarray) -> pa.Array:
    """Cut a BREAK-terminated stream back into one list per text."""
    stops = np.flatnonzero(flat == BREAK)
    offsets = np.concatenate(([0], stops - np.arange(stops.size))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[flat != BREAK].astype(np.int32)))


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """[first, end) of consecutive rows of about ``SLICE_CHARS`` in all, one row at least."""
    ends = np.cumsum(sizes)
    first, done = 0, 0
    while first < sizes.size:
        end = max(first + 1, int(np.searchsorted(ends, done + SLICE_CHARS, side="right")))
        yield first, end
        first, done = end, int(ends[end - 1])


def _joined(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def _flat_ids(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the lists in one array, and where each list ends there; null has none."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(), np.cumsum(sizes, dtype=np.int64)


def encode_column(chars: Sequence[str], merges: Sequence[tuple[int, int, int]] = (), strict: bool = True):
    """Column function text -> array<int>.

    ``strict`` raises on an unknown character (character coding); otherwise
    unknown characters are skipped (subword coding).  ``chars`` is bounded by
    Unicode and ``merges`` by the vocabulary.
    """
    table = lookup_table(chars)
    rules = MergeRanks(merges)

    @F.arrow_udf(S.ArrayType(S.IntegerType()))
    def encode(values: pa.Array) -> pa.Array:
        sizes = pc.utf8_length(values).fill_null(0).to_numpy(zero_copy_only=False)
        return _joined([coded(values[first:end].to_pylist()) for first, end in _slices(sizes)])

    def coded(texts: list[str | None]) -> pa.Array:
        pieces = []
        for value in texts:
            ids = look_up(table, value or "")
            if strict and (ids == BREAK).any():
                unknown = (value or "")[int(np.argmax(ids == BREAK))]
                raise ValueError(f"character not in vocabulary: {unknown!r}")
            pieces += [ids[ids != BREAK], np.array([BREAK], dtype=np.int32)]
        return _as_lists(rules.apply(np.concatenate(pieces)))

    return encode


def merge_column(left: int, right: int, new: int):
    """Column function array<int> -> array<int> with one pair merged."""

    @F.arrow_udf(S.ArrayType(S.IntegerType()))
    def merge(values: pa.Array) -> pa.Array:
        flat, ends = _flat_ids(values)
        starts, out = np.append(0, ends), []
        for first, end in _slices(np.diff(starts)):
            ids = np.insert(flat[starts[first] : starts[end]].astype(np.int32), ends[first:end] - starts[first], BREAK)
            out.append(_as_lists(merge_pair(ids, left, right, new)))
        return _joined(out)

    return merge


def decode_column(tokens: Sequence[str]):
    """Column function array<int> -> text."""
    table = np.array(list(tokens), dtype=object)

    @F.arrow_udf(S.StringType())
    def decode(values: pa.Array) -> pa.Array:
        flat, ends = _flat_ids(values)
        known = values.is_valid().to_pylist()
        return pa.array(
            ["".join(table[flat[start:end]]) if there else None for there, start, end in zip(known, np.append(0, ends).tolist(), ends.tolist())],
            type=pa.string(),
        )

    return decode


def count_windows(texts: Sequence[str], order: int) -> tuple[list[str], np.ndarray]:
    """Distinct ``order``-character windows inside the texts, with their counts."""
    points = [code_points(t) for t in texts if t]
    if not points:
        return [], np.empty(0, dtype=np.int64)
    stream = np.concatenate(points)
    owner = np.repeat(np.arange(len(points)), [p.size for p in points])
    if stream.size < order:
        return [], np.empty(0, dtype=np.int64)
    alphabet, ids = np.unique(stream, return_inverse=True)
    ids, span = ids.astype(np.int64), alphabet.size
    codes = ids
    for step in range(1, order):
        if span * alphabet.size >= 1 << 62:  # renumber before the code would overflow
            known, codes = np.unique(codes, return_inverse=True)
            span = known.size
        codes = codes[:-1] * alphabet.size + ids[step:]
        span *= alphabet.size
    starts = np.flatnonzero(owner[: codes.size] == owner[order - 1 :])
    if starts.size == 0:
        return [], np.empty(0, dtype=np.int64)
    _, first, counts = np.unique(codes[starts], return_index=True, return_counts=True)
    at = starts[first]
    flat = stream[at[:, None] + np.arange(order)].tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i : i + order] for i in range(0, len(flat), order)], counts



def window_counts(table: DataFrame, text: str, order: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of all ``order``-character windows, pre-aggregated inside the tasks.

    The tasks emit one row per distinct window and slice, so the shuffle sees a
    small part of the positions.
    """
    group = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*[batch.column(g).to_pylist() for g in group])) if group else [()] * batch.num_rows
            waiting: dict[tuple, list[str]] = {}
            size = 0
            for key, value in zip(keys, (v for part in text_slices(batch.column("_text")) for v in part)):
                waiting.setdefault(key, []).append(value or "")
                size += len(value or "")
                if size >= SLICE_CHARS:
                    yield from emit(waiting)
                    waiting, size = {}, 0
            yield from emit(waiting)

    def emit(waiting: dict[tuple, list[str]]) -> Iterator[pa.RecordBatch]:
        for key, values in waiting.items():
            grams, counts = count_windows(values, order)
            columns = {g: pa.array([k] * len(grams), pa.string()) for g, k in zip(group, key)}
            yield pa.RecordBatch.from_pydict({**columns, "gram": pa.array(grams, pa.string()), "n": pa.array(counts, pa.int64())})

    schema = S.StructType([*[S.StructField(g, S.StringType()) for g in group], S.StructField("gram", S.StringType()), S.StructField("n", S.LongType())])
    partial = table.select(*[F.col(g).cast("string").alias(g) for g in group], F.col(text).alias("_text")).mapInArrow(run, schema)
    return partial.groupBy(*group, "gram").agg(F.sum("n").alias("n"))
