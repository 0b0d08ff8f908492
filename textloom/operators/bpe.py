"""Byte-pair encoding learned over the whole stream, one pass per group of merges.

A pass counts all pairs of the stream, and what changes in these counts if the
merges that the driver expects next are done one after another.  From the exact
counts the driver then picks merge by merge: as long as it picks what it had
expected, the counts after that merge are known too.  What to expect comes from
some slices of the stream; a wrong guess costs a pass, it never makes a merge.

Token rows are 16-bit or 32-bit numbers in one binary value, few to a file, so
that a task holds few of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from copy import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from textloom.functions.coding import BREAK, encode_column, look_up, lookup_table, merge_pair, pair_places
from textloom.functions.vectorized import code_points
from textloom.operators.stream import placed_units
from textloom.session import discard, materialize

MAX_CHUNKS = 1 << 20
LOOKAHEAD = 64     # best pairs the driver sees per pass, if nothing is expected
EXPECTED = 48      # merges tried ahead in a pass
RANKED = 4096      # best pairs the driver sees per pass otherwise
REWRITE_AFTER = 48  # merges between rewrites of the token table
DENSE_PAIRS = 1 << 22  # possible pairs that a task keeps a number for
RIM = 48           # tokens at either end of a chunk that the driver sees
SLICES, SLICE_TOKENS = 32, 1 << 15  # of the stream, that say what to expect
#: A reader decodes thousands of rows of a file at a time, so a table of chunks has few to a file.
FEW_ROWS = {"maxRecordsPerFile": 8, "compression": "zstd"}

_STATS = S.StructType(
    [S.StructField(n, S.LongType()) for n in ("chunk", "left", "right", "n", "at", "lead", "trail", "step")]
    + [S.StructField("edge", S.BooleanType()), S.StructField("rim", S.BinaryType())]
)


@dataclass(frozen=True)
class Merge:
    left: int
    right: int
    new: int
    absorbs: np.ndarray  # chunks whose last token takes the next chunk's first one
    yields: np.ndarray   # chunks that give their first token away


@dataclass
class BpeModel:
    base: list[str]
    merges: list[tuple[int, int, int]] = field(default_factory=list)
    log: list[tuple[int, str, str, str, int, int, int]] = field(default_factory=list)
    vocab: list[str] = field(default_factory=list)
    orig_len: int = 0
    tokens: DataFrame | None = None


def stream_chunks(docs: DataFrame, key: str, text: str, chunk_chars: int) -> DataFrame:
    """Consecutive slices of the stream, whole units each, numbered densely."""
    placed = materialize(placed_units(docs, key, text), "units")
    total = placed.agg(F.sum("n")).first()[0] or 0
    width = max(chunk_chars, -(-total // MAX_CHUNKS))
    ordered = F.array_sort(F.collect_list(F.struct("start", "unit")))
    body = placed.groupBy(F.floor(F.col("start") / width).alias("slot")).agg(
        F.array_join(F.transform(ordered, lambda u: u["unit"]), "").alias("body")
    )
    slots = placed.select(F.floor(F.col("start") / width).alias("slot")).distinct()
    dense = slots.select("slot", F.row_number().over(Window.orderBy("slot")).cast("bigint").alias("chunk"))
    return body.join(dense, "slot").select("chunk", "body")


def _holds(ordered: np.ndarray, chunk: int) -> bool:
    at = int(np.searchsorted(ordered, chunk))
    return at < ordered.size and ordered[at] == chunk


def _apply(chunk: int, ids: np.ndarray, merges: Sequence[Merge]) -> np.ndarray:
    for m in merges:
        if _holds(m.yields, chunk):
            ids = ids[1:]
        ids = merge_pair(ids, m.left, m.right, m.new)
        if _holds(m.absorbs, chunk):
            ids = np.append(ids[:-1], np.int32(m.new))
    return ids


def _number(size: int) -> str:
    """Type of the numbers of ``size`` different tokens in a token row."""
    return "<u2" if size <= 1 << 16 else "<i4"


def _rows(batches: Iterator[pa.RecordBatch], number: str) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        lists = pa.types.is_list(batch.schema.field("ids").type)
        for chunk, ids in zip(batch.column("chunk").to_pylist(), batch.column("ids")):
            yield chunk, np.asarray(ids.values, dtype=np.int32) if lists else np.frombuffer(ids.as_buffer(), number).astype(np.int32)


def _token_row(chunk: int, ids: np.ndarray, number: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "ids": pa.array([ids.astype(number).tobytes()], pa.binary())})


def _base_characters(chunks: DataFrame) -> list[str]:
    """The distinct characters of the chunks, sorted (at most one per code point)."""

    def run(batches):
        seen = np.zeros(0x110000, dtype=bool)
        for batch in batches:
            for body in batch.column("body"):
                seen[code_points(body.as_py() or "")] = True
        yield pa.RecordBatch.from_pydict({"code": pa.array(np.flatnonzero(seen), pa.int64())})

    return [chr(r["code"]) for r in chunks.select("body").mapInArrow(run, "code bigint").distinct().orderBy("code").collect()]


def _encoded(chunks: DataFrame, base: list[str], number: str) -> DataFrame:
    table = lookup_table(base)

    def run(batches):
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                yield _token_row(chunk, look_up(table, body.as_py() or ""), number)

    return materialize(chunks.mapInArrow(run, "chunk bigint, ids binary"), "tokens", **FEW_ROWS)


def _rewritten(tokens: DataFrame, merges: Sequence[Merge], size: int, number: str) -> DataFrame:
    def run(batches):
        merger = _Merger(merges, size)
        for chunk, ids in _rows(batches, number):
            yield _token_row(chunk, merger.apply(chunk, ids), number)

    return materialize(tokens.mapInArrow(run, "chunk bigint, ids binary"), "tokens", **FEW_ROWS)


def _as_lists(tokens: DataFrame, merges: Sequence[Merge], size: int, number: str) -> DataFrame:
    """The token table after the merges, with its ids as array<int>."""

    def run(batches):
        merger = _Merger(merges, size)
        for chunk, ids in _rows(batches, number):
            ids = merger.apply(chunk, ids)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, ids.size], pa.int32()), pa.array(ids)),
            })

    return materialize(tokens.mapInArrow(run, "chunk bigint, ids array<int>"), "tokens", **FEW_ROWS)


class _Merger:
    """Merges one after another in a chunk, each at the cost of the places where its pair stands.

    A place waits under the merge whose pair starts there, as in ``MergeRanks``.
    A merge (a, b) -> c takes pairs (x, a), (a, b) and (b, y) away and makes
    pairs (x, c) and (c, y); their numbers are kept by x and y if asked for.
    """

    def __init__(self, merges: Sequence[Merge], size: int, counted: bool = False):
        self.merges, self.size = merges, size
        self.rank = None
        if size * size <= DENSE_PAIRS:
            self.rank = np.full(size * size, -1, dtype=np.int16)
            for r, m in reversed(list(enumerate(merges))):
                self.rank[m.left * size + m.right] = r
        # by merge: pairs (x, a) and (b, y) that went, (x, c) and (c, y) that came
        self.changes = np.zeros((len(merges), 4, size), dtype=np.int64) if counted else None
        self.taken = np.zeros(len(merges), dtype=np.int64)

    def apply(self, chunk: int, ids: np.ndarray) -> np.ndarray:
        if not self.merges or not ids.size:
            return ids
        if self.rank is None:
            return _apply(chunk, ids, self.merges)
        end = ids.size
        ids = np.append(ids, BREAK).astype(np.int32)  # the last place stands for both ends
        after, before = np.arange(1, end + 2, dtype=np.int32), np.arange(-1, end, dtype=np.int32)
        before[0] = end
        after[end], before[end] = 0, end - 1
        alive = np.ones(end + 1, dtype=bool)
        waiting: list[list[np.ndarray]] = [[] for _ in self.merges]

        def wait(places: np.ndarray, least: int) -> None:
            left, right = ids[places], ids[after[places]]
            held = (left >= 0) & (right >= 0)
            places = places[held]
            rank = self.rank[left[held].astype(np.int64) * self.size + right[held]]
            held = np.flatnonzero(rank >= least)
            places, rank = places[held], rank[held]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, low, high in zip(rank[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), rank.size]):
                waiting[r].append(places[low:high])

        def count(r: int, kind: int, tokens: np.ndarray) -> None:
            if self.changes is not None:
                self.changes[r, kind] += np.bincount(tokens[tokens >= 0], minlength=self.size)

        wait(np.arange(end), 0)
        for r, m in enumerate(self.merges):
            if _holds(m.yields, chunk):
                first = after[end]
                follows = after[first]
                count(r, 1, ids[[follows]])
                alive[first] = False
                after[end], before[follows] = follows, end
                self.taken[r] += 1
            if waiting[r]:
                at = np.sort(np.concatenate(waiting[r]))
                at = at[np.concatenate(([True], at[1:] != at[:-1]))[: at.size]]
                at = at[alive[at] & (ids[at] == m.left)]
                at = at[ids[after[at]] == m.right]
                if m.left == m.right and at.size:
                    # in a run of equal tokens every second place starts a merge
                    fresh = np.concatenate(([True], after[at[:-1]] != at[1:]))
                    place = np.arange(at.size)
                    at = at[(place - place[fresh][np.cumsum(fresh) - 1]) % 2 == 0]
                if at.size:
                    gone = after[at]
                    follows = after[gone]
                    if self.changes is not None:
                        count(r, 0, ids[before[at]])
                        # where the next place is merged too, the pair between them is counted from there
                        apart = np.concatenate((follows[:-1] != at[1:], [True]))
                        count(r, 1, ids[follows[apart]])
                    ids[at] = m.new
                    alive[gone] = False
                    after[at] = follows
                    before[follows] = at
                    if self.changes is not None:
                        count(r, 2, ids[before[at[np.concatenate(([True], apart[:-1]))]]])
                        count(r, 3, ids[after[at]])
                    self.taken[r] += at.size
                    wait(np.concatenate((at, before[at])), r + 1)
            if _holds(m.absorbs, chunk):
                last = before[end]
                count(r, 0, ids[[before[last]]])
                count(r, 2, ids[[before[last]]])
                ids[last] = m.new
                wait(before[[last]], r + 1)
        return ids[:end][alive[:end]]


def _statistics_batch(chunk, left, right, n, at, lead, trail, edge: bool, step=None, rim=None) -> pa.RecordBatch:
    columns = zip(_STATS.names, (chunk, left, right, n, at, lead, trail, [-1] * len(chunk) if step is None else step))
    return pa.RecordBatch.from_pydict({
        **{name: pa.array(values, pa.int64()) for name, values in columns}, "edge": pa.array([edge] * len(chunk), pa.bool_()),
        "rim": pa.array([None] * len(chunk) if rim is None else rim, pa.binary()),
    })


def _changes_batch(merger: _Merger) -> pa.RecordBatch:
    """(step, left, right, n): what each merge of a task changes in the counts; left -1 has the tokens that it takes."""
    step, kind, token = np.nonzero(merger.changes)
    n = merger.changes[step, kind, token] * np.where(kind < 2, -1, 1)
    left_of, right_of, new_of = (np.array([getattr(m, name) for m in merger.merges], dtype=np.int64) for name in ("left", "right", "new"))
    left = np.choose(kind, (token, right_of[step], token, new_of[step]))
    right = np.choose(kind, (left_of[step], token, new_of[step], token))
    steps = np.arange(len(merger.merges))
    step, left, right, n = (np.concatenate(x) for x in ((step, steps), (left, np.full(steps.size, -1)), (right, np.full(steps.size, -1)), (n, merger.taken)))
    none = np.zeros(step.size, dtype=np.int64)
    return _statistics_batch(none, left, right, n, none, none, none, False, step)


class _PairCounts:
    """Counts of the pairs in a task's chunks and where each is first; one number per possible pair."""

    def __init__(self, size: int):
        self.size = size
        self.n, self.chunk, self.at = (np.full(size * size, fill, dtype=np.int64) for fill in (0, np.iinfo(np.int64).max, 0))

    def add(self, chunk: int, ids: np.ndarray) -> None:
        codes = ids[:-1].astype(np.int64) * self.size + ids[1:]
        if codes.size < self.n.size // 8:
            found, first, counts = np.unique(codes, return_index=True, return_counts=True)
            self.n[found] += counts
            new = self.chunk[found] > chunk
            self.chunk[found[new]], self.at[found[new]] = chunk, first[new]
            return
        counts = np.bincount(codes, minlength=self.n.size)
        self.n += counts
        new = np.flatnonzero((counts > 0) & (self.chunk > chunk))
        if new.size:
            first = np.empty(self.n.size, dtype=np.int64)
            first[codes[::-1]] = np.arange(codes.size - 1, -1, -1)  # of equal places the last one written counts
            self.chunk[new], self.at[new] = chunk, first[new]

    def batch(self) -> pa.RecordBatch:
        found = np.flatnonzero(self.n)
        none = np.zeros(found.size, dtype=np.int64)
        return _statistics_batch(self.chunk[found], found // self.size, found % self.size, self.n[found], self.at[found], none, none, False)


def _pass_statistics(tokens: DataFrame, merges: Sequence[Merge], size: int, number: str = "<i4", expected: Sequence[Merge] = ()) -> DataFrame:
    """Pair counts of each task, one edge row per non-empty chunk, of ``size`` different tokens, and what the expected merges change.

    Where a number for every possible pair is too much, each chunk has its own counts.
    """

    def run(batches):
        counts = _PairCounts(size) if size * size <= DENSE_PAIRS else None
        done, ahead = _Merger(merges, size), _Merger(expected, size + len(expected), True)
        for chunk, ids in _rows(batches, number):
            ids = done.apply(chunk, ids)
            if ids.size == 0:
                continue
            turns = np.flatnonzero(ids[1:] != ids[:-1])
            lead = int(turns[0]) + 1 if turns.size else ids.size
            trail = ids.size - 1 - int(turns[-1]) if turns.size else ids.size
            width = min(RIM, ids.size // 2)
            rim = np.concatenate((ids[:width], ids[ids.size - width :])).astype("<i4").tobytes()
            yield _statistics_batch([chunk], [ids[0]], [ids[-1]], [ids.size], [0], [lead], [trail], True, None, [rim])
            if counts:
                counts.add(chunk, ids)
                ahead.apply(chunk, ids)
                continue
            wide = ids.astype(np.int64)
            codes, first, found = np.unique((wide[:-1] << 32) | wide[1:], return_index=True, return_counts=True)
            none = np.zeros(codes.size, dtype=np.int64)
            yield _statistics_batch(none + chunk, codes >> 32, codes & 0xFFFFFFFF, found, first, none, none, False)
        if counts:
            yield counts.batch()
            yield _changes_batch(ahead)

    return tokens.mapInArrow(run, _STATS)


def _best_pairs(stats: DataFrame, limit: int) -> list:
    """Most frequent pairs; ties by first position in the stream."""
    edges = stats.where("edge")
    # One row per chunk, at most MAX_CHUNKS: a single ordered window is bounded.
    crossing = edges.select(
        "chunk", F.col("right").alias("left"), F.lead("left").over(Window.orderBy("chunk")).alias("right"),
        F.lit(1).cast("bigint").alias("n"), (F.col("n") - 1).alias("at"),
    ).where(F.col("right").isNotNull())
    inside = stats.where("not edge and step < 0").select("chunk", "left", "right", "n", "at")
    counted = inside.unionByName(crossing).groupBy("left", "right").agg(
        F.sum("n").alias("n"), F.min("chunk").alias("chunk"), F.min_by("at", F.struct("chunk", "at")).alias("at")
    )
    return counted.orderBy(F.col("n").desc(), "chunk", "at").limit(limit).collect()


def _independent_prefix(best: list, ceiling: int) -> list:
    """Merges that the one-at-a-time procedure would pick next in exactly this order.

    Merging (a, b) takes occurrences only from pairs that end in a or begin
    with b, and every pair it creates is at most as frequent as one of those.
    Pairs that share just their first or just their second token stand at
    different places and leave each other alone.  So the ranking can be
    followed up to the first pair that begins where a chosen one ends or the
    other way round, as long as counts stay strictly above that pair's and
    above ``ceiling``, the most that a pair not given here can have.
    """
    if len(best) <= 1 or best[0]["left"] == best[0]["right"]:
        return best[:1]
    chosen, lefts, rights = [], set(), set()
    for pair in best:
        if pair["left"] == pair["right"] or pair["left"] in rights or pair["right"] in lefts:
            ceiling = max(ceiling, pair["n"])
            break
        chosen.append(pair)
        lefts.add(pair["left"])
        rights.add(pair["right"])
    return [p for i, p in enumerate(chosen) if i == 0 or (p["n"] > ceiling and p["n"] >= 2)]


def _border_moves(edges: list, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Which chunk borders the merge crosses, following left-to-right order."""
    absorbs, yields = [], []
    open_left = None
    for e in edges:
        taken = open_left is not None and e["left"] == right
        if taken:
            absorbs.append(open_left)
            yields.append(e["chunk"])
        size = e["n"] - taken
        if size == 0:
            open_left = None
        elif left != right:
            open_left = e["chunk"] if e["right"] == left else None
        elif e["right"] != left:
            open_left = None
        else:
            run = size if e["lead"] == e["n"] else e["trail"]
            open_left = e["chunk"] if run % 2 else None
    return np.array(absorbs, dtype=np.int64), np.array(yields, dtype=np.int64)


class _Borders:
    """The tokens around the chunk borders, as far as they are sure, merge after merge.

    What lies beyond the tokens seen may take the outermost one, so that a merge
    may cost one of them, or a whole run of equal ones.
    """

    def __init__(self, edges: list):
        parts, sides, owners = [], [], []
        for e, f in zip(edges, edges[1:]):
            last, first = (np.frombuffer(x["rim"], "<i4") for x in (e, f))
            last, first = last[last.size // 2 :], first[: first.size // 2]
            parts += [last, first, [BREAK]]
            sides += [0] * last.size + [1] * first.size + [-1]
            owners.append(e["chunk"])
        self.ids = np.concatenate([np.empty(0, dtype=np.int32), *parts]).astype(np.int32)
        self.side = np.array(sides, dtype=np.int8)
        self.owners = np.array(owners, dtype=np.int64)
        self.nexts = np.array([e["chunk"] for e in edges[1:]], dtype=np.int64)

    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each window; a window without any has the first after the last."""
        breaks = np.flatnonzero(self.ids == BREAK)
        return np.concatenate(([0], breaks[:-1] + 1))[: breaks.size], breaks - 1

    def crossing(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Left and right token of the pair on each border; None if one is not sure."""
        at = np.flatnonzero((self.side[:-1] == 0) & (self.side[1:] == 1))
        return (self.ids[at], self.ids[at + 1]) if at.size == self.owners.size else None

    def merge(self, left: int, right: int, new: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Chunks that absorb and those that yield; None if that is not sure."""
        if self.crossing() is None:
            return None
        if not self.owners.size:
            return self.owners, self.owners
        keep = np.ones(self.ids.size, dtype=bool)
        first, last = self._bounds()
        if left != right:
            keep[first[self.ids[first] == right]] = False
            keep[last[self.ids[last] == left]] = False
        else:
            # the run at the front may begin earlier, and the one at the back go on
            turns = np.flatnonzero(self.ids != left)
            until = turns[np.searchsorted(turns, first)]
            for f, u in zip(first[until > first], until[until > first]):
                keep[f:u] = False
            since = np.where(np.searchsorted(turns, last, side="right") > 0, turns[np.searchsorted(turns, last, side="right") - 1], -1)
            keep[last[((last - since) % 2 == 1) & (last >= until)]] = False
        self.ids, self.side = self.ids[keep], self.side[keep]
        if self.crossing() is None:
            return None
        hit = pair_places(self.ids, left, right)
        over = hit[(self.side[hit] == 0) & (self.side[hit + 1] == 1)]
        at = np.searchsorted(np.flatnonzero(self.ids == BREAK), over)
        self.ids[hit] = new
        keep = np.ones(self.ids.size, dtype=bool)
        keep[hit + 1] = False
        self.ids, self.side = self.ids[keep], self.side[keep]
        return self.owners[at], self.nexts[at]


class _Guess:
    """What the next merges may be: exact counts where they are known, carried on with those of some slices of the stream."""

    def __init__(self, tokens: DataFrame, number: str, most: int):
        step = max(1, tokens.count() // SLICES)
        width = np.dtype(number).itemsize
        rows = tokens.where(F.col("chunk") % step == 0).limit(SLICES).select(F.substring("ids", 1, SLICE_TOKENS * width).alias("ids")).collect()
        self.ids = np.concatenate([np.empty(0, dtype=np.int32), *(np.append(np.frombuffer(r["ids"], number).astype(np.int32), BREAK) for r in rows)])
        self.size = most  # of the vocabulary in the end
        self.counts = self._counted(self.ids).astype(np.float64)
        self.scale = 1.0

    def _counted(self, ids: np.ndarray) -> np.ndarray:
        held = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        return np.bincount(ids[held].astype(np.int64) * self.size + ids[held + 1], minlength=self.size * self.size)

    def follow(self, merges: list[tuple[int, int, int]]) -> None:
        """Do merges in the slices; counts have to be given afterwards."""
        for merge in merges:
            self.ids = merge_pair(self.ids, *merge)

    def known(self, counts: dict, length: int) -> None:
        """Exact counts of the pairs that matter, after the merges done here so far."""
        self.scale = length / max(1, int((self.ids >= 0).sum()))
        self.counts = self._counted(self.ids) * self.scale
        if counts:
            pairs = np.array(list(counts), dtype=np.int64)
            self.counts[pairs[:, 0] * self.size + pairs[:, 1]] = list(counts.values())

    def _merged(self, ids: np.ndarray, counts: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
        hit = pair_places(ids, left, right)
        done = ids.copy()
        done[hit] = new
        keep = np.ones(ids.size, dtype=bool)
        keep[hit + 1] = False
        done = done[keep]
        now = hit - np.arange(hit.size)
        for own, starts, sign in ((ids, (hit - 1, hit, hit + 1), -self.scale), (done, (now - 1, now), self.scale)):
            at = np.unique(np.concatenate(starts))
            at = at[(at >= 0) & (at < own.size - 1)]
            at = at[(own[at] >= 0) & (own[at + 1] >= 0)]
            np.add.at(counts, own[at].astype(np.int64) * self.size + own[at + 1], sign)
        counts[left * self.size + right] = 0
        return done

    def take(self, left: int, right: int, new: int) -> None:
        self.ids = self._merged(self.ids, self.counts, left, right, new)

    def ahead(self, next_id: int, most: int) -> list[tuple[int, int, int]]:
        ids, counts, out = self.ids, self.counts.copy(), []
        while len(out) < most:
            best = int(np.argmax(counts))
            if counts[best] < 2:
                break
            out.append((best // self.size, best % self.size, next_id + len(out)))
            ids = self._merged(ids, counts, *out[-1])
        return out


class _Counts:
    """Exact counts of the pairs that can come next, merge after merge of those expected."""

    def __init__(self, stats: DataFrame | None, best: list, limit: int, expected: list, borders: list):
        self.ceiling = best[-1]["n"] if len(best) == limit else 0  # no pair that isn't here stands more often
        self.counts = {(p["left"], p["right"]): p["n"] for p in best}
        self.places = {(p["left"], p["right"]): (p["chunk"], p["at"]) for p in best}
        self.changes: list[list] = [[] for _ in expected]
        self.taken = [0] * len(expected)
        columns = ("step", "left", "right", "n")
        changed = stats.where("step >= 0").groupBy(*columns[:3]).agg(F.sum("n").alias("n")).where("n <> 0").toArrow() if stats else None
        for step, left, right, n in zip(*(changed.column(c).to_pylist() for c in columns)) if changed else ():
            if left < 0:
                self.taken[step] = n
            else:
                self.changes[step].append((left, right, n))
        self.expected, self.borders = expected, borders
        self.oldest = min((m[2] for m in expected), default=0)

    def step(self, at: int) -> None:
        """Go on by the expected merge ``at``."""
        left, right, new = self.expected[at]
        for x, y, n in self.changes[at]:
            self._add((x, y), n)
        for x, y, n in ((x, y, n) for sign, border in ((-1, self.borders[at]), (1, self.borders[at + 1])) for x, y, n in zip(*border, [sign] * len(border[0]))):
            self._add((int(x), int(y)), n)
        self.counts.pop((left, right), None)
        self.places = {}

    def _add(self, pair: tuple[int, int], n: int) -> None:
        # what isn't among the best and has no new token stays below the ceiling
        if pair in self.counts or max(pair) >= self.oldest:
            self.counts[pair] = self.counts.get(pair, 0) + n

    def ranking(self) -> list[dict]:
        """The pairs, best first, as far as the order is sure: ties by place where that is known, else up to the first tie."""
        ordered = sorted(self.counts, key=lambda p: (-self.counts[p], self.places.get(p, (0, 0))))[: LOOKAHEAD + 1]
        out = []
        for i, p in enumerate(ordered):
            base = bool(self.places)
            tie = not base and i + 1 < len(ordered) and self.counts[ordered[i + 1]] == self.counts[p]
            if self.counts[p] < 2 or tie or (not base and self.counts[p] <= self.ceiling) or len(out) == LOOKAHEAD:
                break
            out.append({"left": p[0], "right": p[1], "n": self.counts[p]})
        self.next = max([self.counts[p] for p in ordered[len(out) : len(out) + 1]] + [self.ceiling])
        return out


def _expected(guess: _Guess | None, borders: _Borders | None, next_id: int, most: int) -> tuple[list, list[Merge], list]:
    """The merges to try ahead, the same with the borders they cross, and the pairs on the borders before and after each."""
    crossing = borders.crossing() if guess and borders else None
    if crossing is None:
        return [], [], []
    ahead, out, moves, crossings = copy(borders), [], [], [crossing]
    for merge in guess.ahead(next_id, most):
        moved = ahead.merge(*merge)
        crossing = ahead.crossing()
        if moved is None or crossing is None:
            break
        out.append(merge)
        moves.append(Merge(*merge, *moved))
        crossings.append(crossing)
    return out, moves, crossings


def _accepted(counts: _Counts, wanted: int, edges: list, borders: _Borders | None, next_id: int, length: int) -> tuple[list, int, dict, int]:
    """The next merges with their log, how many of them the counts follow, those counts, and the tokens left then."""
    out: list[tuple] = []
    names: dict[int, int] = {}  # ids that were expected -> ids by the order in which merges come
    expected, at = counts.expected, 0
    while len(out) < wanted:
        base = at == 0
        chosen = _independent_prefix(counts.ranking(), counts.next)[: wanted - len(out)]
        pairs = [(p["left"], p["right"]) for p in chosen]
        # these merges leave each other alone, so that their order changes nothing but ids
        follow = next((n for n in range(min(len(pairs), len(expected) - at), 0, -1) if set(pairs[:n]) == {m[:2] for m in expected[at : at + n]}), 0)
        steps = {m[:2]: at + n for n, m in enumerate(expected[at : at + follow])}
        left_then = length
        for pair, p in list(zip(pairs, chosen))[: follow or None]:
            left, right, new = names.get(pair[0], pair[0]), names.get(pair[1], pair[1]), next_id + len(out)
            moved = borders.merge(left, right, new) if borders else None
            if moved is None and base:
                moved = _border_moves(edges, left, right)
            if moved is None:
                break
            if pair in steps:
                left_then -= counts.taken[steps[pair]]
            else:  # a pair of equal tokens may overlap itself: its effect shows in the next pass
                left_then = -1 if left == right else left_then - p["n"]
            out.append((Merge(left, right, new, *moved), p["n"], left_then))
        if follow == 0 or len(out) < at + follow:
            break
        for n, (m, *_) in enumerate(out[at : at + follow]):
            names[expected[steps[pairs[n]]][2]] = m.new
        for n in range(at, at + follow):
            counts.step(n)
        at, length = at + follow, left_then
        if borders.crossing() is None:
            break
    return out, at, {(names.get(x, x), names.get(y, y)): n for (x, y), n in counts.counts.items()}, length


def train_bpe(docs: DataFrame, num_merges: int, key: str = "doc_id", text: str = "text", chunk_chars: int = 1 << 20) -> BpeModel:
    """Learn merges in the order of the one-pair-at-a-time procedure, ties included.

    Pairs that cross document and chunk borders count, because the corpus is
    one stream.  The driver holds the vocabulary, the merge list, ``RANKED``
    pairs and what ``EXPECTED`` merges change, one edge row of at most
    2 * ``RIM`` tokens per chunk and ``SLICES`` short slices of the stream.
    """
    chunks = materialize(stream_chunks(docs, key, text, chunk_chars), "chunks", heavy=True, **FEW_ROWS)
    base = _base_characters(chunks)
    number = _number(len(base) + num_merges)
    tokens = _encoded(chunks, base, number)
    discard(chunks, "chunks")
    model = BpeModel(base, vocab=list(base))
    most = len(base) + num_merges
    guess = _Guess(tokens, number, most) if num_merges and (most + EXPECTED) ** 2 <= DENSE_PAIRS else None
    pending: list[Merge] = []
    borders = None
    while True:
        wanted = num_merges - len(model.merges)
        expected, moves, crossings = _expected(guess, borders, len(model.vocab), min(EXPECTED, wanted))
        # read several times within the pass; a lost block is computed again from the token table
        stats = _pass_statistics(tokens, pending, len(model.vocab), number, moves).persist()
        columns = ["chunk", "left", "right", "n", "lead", "trail", *(["rim"] if guess else [])]
        edges = sorted(stats.where("edge").select(*columns).collect(), key=lambda e: e["chunk"])
        length = sum(e["n"] for e in edges)
        if not model.merges:
            model.orig_len = length
        elif model.log[-1][-1] < 0:
            model.log[-1] = (*model.log[-1][:-1], length)
        most_seen = RANKED if guess else LOOKAHEAD
        best = [p for p in _best_pairs(stats, most_seen) if p["n"] >= 2] if wanted > 0 else []
        borders = _Borders(edges) if guess else None
        counts = _Counts(stats if moves else None, best, most_seen, expected, crossings)
        stats.unpersist()
        if not best:
            break
        accepted, followed, known, length = _accepted(counts, wanted, edges, borders, len(model.vocab), length)
        for merge, n, left_then in accepted:
            pending.append(merge)
            model.merges.append((merge.left, merge.right, merge.new))
            model.vocab.append(model.vocab[merge.left] + model.vocab[merge.right])
            model.log.append((len(model.merges), model.vocab[merge.left], model.vocab[merge.right], model.vocab[merge.new], n, len(model.vocab), left_then))
        if guess:
            new = model.merges[len(model.merges) - len(accepted) :]
            guess.follow(new[:followed])
            guess.known(known, length)
            for merge in new[followed:]:
                guess.take(*merge)
        if len(pending) >= REWRITE_AFTER:
            tokens, pending, done = _rewritten(tokens, pending, len(model.vocab), number), [], tokens
            discard(done, "tokens")
    model.tokens = _as_lists(tokens, pending, len(model.vocab), number)
    discard(tokens, "tokens")
    return model


def merge_log(spark, model: BpeModel) -> DataFrame:
    """Audit table: step, pair, merged token, frequency, vocabulary size, tokens left."""
    return spark.createDataFrame(
        model.log, "step bigint, left string, right string, merged string, freq bigint, vocab_size bigint, seq_len bigint"
    )


def monitor_view(log: DataFrame, first: int = 30, every: int = 50) -> DataFrame:
    last = log.agg(F.max("step")).scalar()
    return log.where((F.col("step") <= first) | (F.col("step") % every == 0) | (F.col("step") == last))


def encode_bpe(texts: DataFrame, model: BpeModel, text: str = "text", ids: str = "ids") -> DataFrame:
    """Apply the merges in learned order; unknown characters are skipped."""
    return texts.withColumn(ids, encode_column(model.base, model.merges, strict=False)(F.col(text)))


def vocabulary_table(spark, model: BpeModel) -> DataFrame:
    return spark.createDataFrame(
        [(i, t, "base" if i < len(model.base) else "merge") for i, t in enumerate(model.vocab)],
        "token_id bigint, token string, kind string",
    )


def merges_table(spark, model: BpeModel) -> DataFrame:
    return spark.createDataFrame(
        [(i + 1, *m) for i, m in enumerate(model.merges)], "step bigint, left_id bigint, right_id bigint, new_id bigint"
    )


def bpe_report(spark, model: BpeModel) -> DataFrame:
    final = model.log[-1][-1] if model.log else model.orig_len
    row = (model.orig_len, len(model.base), len(model.merges), len(model.vocab), final)
    sizes = spark.createDataFrame(
        [row], "orig_chars bigint, base_vocab bigint, num_merges bigint, final_vocab bigint, final_seq_len bigint"
    )
    return sizes.select(
        "*",
        F.round(F.try_divide("final_seq_len", "orig_chars"), 3).alias("compression"),
        F.round(F.try_divide("orig_chars", "final_seq_len"), 2).alias("chars_per_token"),
    )


def longest_fragments(vocab: DataFrame, top: int = 25) -> DataFrame:
    """Longest learned tokens; equal lengths in id order."""
    return vocab.where(F.length("token") > 1).orderBy(F.length("token").desc(), "token_id").limit(top).select(
        "token_id", "token", F.length("token").cast("bigint").alias("length")
    )


def save_tokenizer(spark, path: str, base: Sequence[str], merges: Sequence[tuple[int, int, int]] = ()) -> None:
    """Persist base characters and merges; the kind is stored with every row."""
    kind = "bpe" if merges else "char"
    spark.createDataFrame(
        [(kind, i, t) for i, t in enumerate(base)], "kind string, token_id bigint, token string"
    ).write.mode("overwrite").parquet(f"{path}/vocab")
    spark.createDataFrame(
        [(i + 1, *m) for i, m in enumerate(merges)], "step bigint, left_id bigint, right_id bigint, new_id bigint"
    ).write.mode("overwrite").parquet(f"{path}/merges")


def load_tokenizer(spark, path: str) -> BpeModel:
    """Rebuild either kind; a character tokenizer simply has no merges."""
    base = [r["token"] for r in spark.read.parquet(f"{path}/vocab").orderBy("token_id").collect()]
    merges = [(r["left_id"], r["right_id"], r["new_id"]) for r in spark.read.parquet(f"{path}/merges").orderBy("step").collect()]
    vocab = list(base)
    for left, right, _ in merges:
        vocab.append(vocab[left] + vocab[right])
    return BpeModel(base, merges, vocab=vocab)
