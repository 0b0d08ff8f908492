"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint is the bitwise majority of the XXH64 values of a text's word
shingles.  Equal fingerprints collapse first.  Two fingerprints that differ in
at most ``distance`` bits agree wholly in some ``exact`` of ``distance +
exact`` bit blocks, so each choice of such blocks deals the fingerprints into
groups of which a linked pair shares at least one.  A group that is too large
for one task is dealt once more by blocks of its remaining bits, which bounds
it by the number of different fingerprints that its free bits leave.

Inside a group the fingerprints are sorted by Gray rank, which puts those with
long common bit patterns side by side.  Runs of them form the leaves of a tree;
a node holds the bits on which everything below agrees, less those its
ancestors hold already.  A search adds up differences on the way down and
leaves out a whole node as soon as they pass ``distance``.  What leaves a group
is a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import per_batch, stored, texts
from textloom.llm.components import components

BITS = 64
SEED = 42
SHINGLE = 3
DISTANCE = 3
EXACT = 3
GROUP = 1024
FANOUT = 8
_ROWS = 1 << 16
_FRONT = 1 << 20


# -- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included; words are runs of anything but ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: touches A-Z only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; zero for none."""
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, hashes.size, _ROWS):
        part = hashes[start : start + _ROWS].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > hashes.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer.  Null, empty and blank texts have zero."""

    def make(batch: pa.RecordBatch) -> dict:
        values = [majority(shingle_hashes(t, width)) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "fp": np.array(values, dtype=np.uint64).view(np.int64)}

    return per_batch(texts(docs), make, "doc_id bigint, fp bigint")


# -- dealing into groups --------------------------------------------------------------------------


def block_masks(free: list[int], blocks: int, exact: int) -> list[int]:
    """One mask for each choice of ``exact`` of ``blocks`` near-equal blocks of the free bit places."""
    cut = [free[i * len(free) // blocks : (i + 1) * len(free) // blocks] for i in range(blocks)]
    return [sum(1 << b for i in choice for b in cut[i]) for choice in combinations(range(blocks), exact)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _keys(masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for m in masks])


def first_deal(distinct: DataFrame, distance: int, exact: int) -> DataFrame:
    masks = block_masks(list(range(BITS)), distance + exact, exact)
    return distinct.select("fp", F.explode(_keys(masks)).alias("k")).select("k.mask", "k.part", "fp")


def second_deal(hot: DataFrame, distance: int, exact: int) -> DataFrame:
    """Deal large groups again, by blocks of the bits that their first key left free."""
    first = block_masks(list(range(BITS)), distance + exact, exact)
    rows = None
    for mask in first:
        free = [b for b in range(BITS) if not mask >> b & 1]
        finer = [mask | m for m in block_masks(free, distance + exact, exact)]
        part = hot.where(F.col("mask") == _signed(mask)).select("fp", F.explode(_keys(finer)).alias("k"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("k.mask", "k.part", "fp")


# -- the index ------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build_index(codes: np.ndarray, group: np.ndarray, fanout: int = FANOUT) -> list[dict[str, np.ndarray]]:
    """Tree levels from the root down over codes sorted by (group, Gray rank).

    A node never spans two groups.  Each level holds the children's range and
    the node's own bits: those all codes below agree on and no ancestor holds.
    """
    levels: list[dict[str, np.ndarray]] = []
    low, high = codes, codes  # and-ed and or-ed codes below each node
    own, first = group, np.arange(codes.size)
    last = first + 1
    while True:
        change = np.r_[True, own[1:] != own[:-1]]
        run = np.flatnonzero(change)
        place = np.arange(own.size) - np.repeat(run, np.diff(np.r_[run, own.size]))
        starts = np.flatnonzero(place % fanout == 0)
        low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
        own, first, last = own[starts], starts, np.r_[starts[1:], own.size]
        levels.append({"group": own, "first": first, "last": last, "mask": ~(low ^ high), "pattern": low})
        if own.size == np.count_nonzero(np.r_[True, own[1:] != own[:-1]]):
            break
    levels.reverse()
    for above, below in zip(levels, levels[1:]):
        held = np.repeat(above["mask"], above["last"] - above["first"])
        below["own"] = below["mask"] & ~held
    levels[0]["own"] = levels[0]["mask"]
    return levels


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row repeated per child, child)."""
    n = last - first
    row = np.repeat(np.arange(n.size), n)
    return row, np.arange(row.size) - np.repeat(np.cumsum(n) - n, n) + first[row]


def search(levels: list[dict[str, np.ndarray]], codes: np.ndarray, queries: np.ndarray, nodes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) places with at most ``distance`` different bits; ``nodes`` are the queries' root nodes."""
    differ = np.zeros(queries.size, dtype=np.int64)
    for depth, level in enumerate(levels):
        differ = differ + np.bitwise_count((codes[queries] ^ level["pattern"][nodes]) & level["own"][nodes])
        keep = differ <= distance
        queries, nodes, differ = queries[keep], nodes[keep], differ[keep]
        row, below = _expand(level["first"][nodes], level["last"][nodes])
        queries, nodes, differ = queries[row], below, differ[row]
    keep = queries < nodes
    queries, nodes = queries[keep], nodes[keep]
    keep = np.bitwise_count(codes[queries] ^ codes[nodes]) <= distance
    return queries[keep], nodes[keep]


def root_nodes(levels: list[dict[str, np.ndarray]], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Root node of each place, and the running sum of pairs that searching the places may meet."""
    roots = levels[0]["group"]
    sizes = np.diff(np.r_[np.searchsorted(group, roots), group.size])
    return np.repeat(np.arange(roots.size), sizes), np.cumsum(np.repeat(sizes, sizes))


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable from every place over the links a-b."""
    root = np.arange(size)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if np.array_equal(before, root):
            return root


def linked(codes: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, other code) that connect the same codes as all links inside the groups do."""
    order = np.lexsort((gray_rank(codes), group))
    codes, group = codes[order], group[order]
    levels = build_index(codes, group)
    root_of, weight = root_nodes(levels, group)
    label = np.arange(codes.size)
    for start, end in cuts(weight, _FRONT):
        a, b = search(levels, codes, np.arange(start, end), root_of[start:end], distance)
        label = forest(codes.size, np.r_[np.arange(codes.size), a], np.r_[label, b])
    own = np.flatnonzero(label != np.arange(codes.size))
    return codes[label[own]], codes[own]


def cuts(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of places to search at once, so that fronts stay small."""
    start, base = 0, 0
    while start < weight.size:
        end = max(start + 1, int(np.searchsorted(weight, base + most, side="right")))
        yield start, end
        start, base = end, int(weight[end - 1])


def forest_edges(dealt: DataFrame, distance: int) -> DataFrame:
    """Links found inside the groups (mask, part); a group lies in one task and is of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        mask, part, fp = (table.column(c).to_numpy().astype(np.int64) for c in ("mask", "part", "fp"))
        order = np.lexsort((part, mask))
        mask, part, fp = mask[order], part[order], fp[order]
        group = np.cumsum(np.r_[True, (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])]) - 1
        several = np.bincount(group)[group] > 1
        if several.any():
            a, b = linked(fp[several].view(np.uint64), group[several], distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.repartition(F.col("mask"), F.col("part")).mapInArrow(run, "a bigint, b bigint")


def links(distinct: DataFrame, distance: int = DISTANCE, exact: int = EXACT, most: int = GROUP) -> DataFrame:
    """Edges between distinct fingerprints that connect whatever lies within ``distance`` bits."""
    dealt = first_deal(distinct, distance, exact)
    sizes = dealt.groupBy("mask", "part").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > most).select("mask", "part"), "large")
    small_edges = forest_edges(dealt.join(large, ["mask", "part"], "left_anti"), distance)
    if large.isEmpty():
        return small_edges
    hot = dealt.join(large, ["mask", "part"], "left_semi")
    finer = second_deal(hot, distance, exact)
    return small_edges.unionByName(forest_edges(finer, distance))


def simhash_dedup(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE, exact: int = EXACT, most: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id, group_size) per row.

    component_id is the smallest doc_id reachable over links of at most
    ``distance`` bits, itself included; group_size counts the rows of equal
    fingerprint.  Null, empty and blank texts have fingerprint zero and link
    like any other.  Repeated rows each get a row; a null doc_id is never the
    smallest unless all are null.  An empty table gives an empty result;
    further columns are ignored.
    """
    prints = stored(fingerprints(docs, width), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("group_size")), "distinct")
    roots = stored(components(links(distinct.select("fp"), distance, exact, most)), "roots")
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "rep", "group_size", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "placed")
    least = stored(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = stored(placed.join(least, "root").select("fp", "group_size", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")
