"""Near-duplicate documents at a similarity of word shingles, by wide SimHash fingerprints.

The SimHash operator links fingerprints that differ in a few of 64 bits.  Texts
of which a fifth of the shingles differ are farther apart than any such bound
that blocks of bits can serve, so here the fingerprint has ``4 * 64`` bits and
the groups come from ``tables`` fixed samples of its bits: as many as leave a
pair of just the wanted similarity out of every group in at most ``MISS`` of
cases.  Inside a group the Gray-order index of the SimHash operator finds the
candidates by the first 64 bits, and all bits then rank them.

Candidates are checked against the true Jaccard similarity of the texts'
shingle sets in rounds.  A round takes ``FORESTS`` edge-disjoint spanning
forests of least distance from each group, over what the links confirmed so
far connect, so copies cost links in proportion to their number.  A forest
link may fail the check and hide others that hold; so members of
which candidates of other components are left over go to the next round.
In the last the shingle sets come to the group: each candidate that is left is
checked inside the task, and only links that hold and connect become rows,
fewer than the group has members.  No candidate is lost: each is checked, or
its ends are connected already.

Groups of over ``GROUP`` fingerprints are dealt again by further bits; what is
still too large is cut into parts by hash, each with the group's smallest
member, which the members of a group that agrees on so many bits resemble.
Where the first round leaves such a group in several components, every two of
its parts meet in the second.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import per_batch, stored, texts
from textloom.llm.components import components
from textloom.llm.simhash import build_index, cuts, forest, gray_rank, majority, root_nodes, search, shingle_hashes
from textloom.llm.words import mixed

WIDTH = 5
SIMILARITY = 0.8
WORDS = ("w0", "w1", "w2", "w3")
BITS = 64 * len(WORDS)
MISS = 0.02
MARGIN = 0.1
GROUP = 1024
REDEALS, MORE_BITS = 8, 10
FORESTS = (1, 8)
BROADCAST_IDS = 2_000_000
BLOCK_SHINGLES = 1 << 20
_FRONT = 1 << 20
_FIRST_SD = 4.0


def share_of_bits(similarity: float) -> float:
    """Expected share of fingerprint bits that differ at a Jaccard similarity of equally large sets."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def wide_prints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, w0..w3) of the texts' distinct shingles."""

    def make(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in batch.column("text").to_pylist():
            hashes = shingle_set(text, width)
            rows.append([majority(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D * n & (1 << 64) - 1))) for n in range(1, len(WORDS) + 1)])
        values = np.array(rows, dtype=np.uint64).reshape(-1, len(WORDS)).view(np.int64)
        return {"doc_id": batch.column("doc_id"), **{w: values[:, i].copy() for i, w in enumerate(WORDS)}}

    return per_batch(texts(docs), make, "doc_id bigint, " + ", ".join(f"{w} bigint" for w in WORDS))


def bit_samples(tables: int, bits: int, seed: int) -> list[list[int]]:
    """``tables`` masks over the words, of ``bits`` sampled places each."""
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        masks = [0] * len(WORDS)
        for place in draw.choice(BITS, size=bits, replace=False).tolist():
            masks[place // 64] |= 1 << place % 64
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return out


def _keys(samples: list[list[int]], *above: Column) -> Column:
    """One key for each sample: a hash of the sampled bits, the sample's number and what is above."""
    return F.array(*[
        F.xxhash64(F.lit(n), *above, *[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(WORDS, masks)]) for n, masks in enumerate(samples)
    ])


def _oversize(dealt: DataFrame, most: int, label: str) -> DataFrame:
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n"))
    return stored(sizes.where(F.col("n") > most), label)


def deal(distinct: DataFrame, similarity: float, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, rep, w0..w3): every fingerprint in each of its groups, none of them over about ``most``.

    Also (dense, part, parts, rep, w0..w3), the members of groups that are cut into parts, if there are any.
    """
    n = max(2, distinct.count())
    differ = share_of_bits(similarity)
    bits = max(12, round(math.log2(n)) - 4)
    tables = math.ceil(math.log(MISS) / math.log(1 - (1 - differ) ** bits))
    dealt = distinct.withColumn("key", F.explode(_keys(bit_samples(tables, bits, 1)))).select("key", "rep", *WORDS)
    large = _oversize(dealt, most, "large")
    if large.isEmpty():
        return dealt, None
    cold = dealt.join(large, "key", "left_anti")
    hot = dealt.join(large.select("key"), "key", "left_semi")
    finer = hot.withColumn("key", F.explode(_keys(bit_samples(REDEALS, MORE_BITS, 2), F.col("key"))))
    dense = _oversize(finer, most, "dense").withColumn("parts", F.ceil(2 * F.col("n") / most).cast("int")).drop("n")
    heads = stored(finer.join(dense, "key").groupBy("key", "parts").agg(F.min(F.struct("rep", *WORDS)).alias("head")), "heads")
    part = F.pmod(F.xxhash64("key", "rep"), F.col("parts")).cast("int")
    cut = stored(finer.join(dense, "key").select(F.col("key").alias("dense"), part.alias("part"), "parts", "rep", *WORDS), "parts")
    members = cut.select(F.xxhash64("dense", "part").alias("key"), "rep", *WORDS)
    heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.xxhash64("key", "part").alias("key"), "head.*")
    return cold.unionByName(finer.join(dense, "key", "left_anti")).unionByName(members).unionByName(heads), cut


def blocks(cut: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(key, rep, w0..w3): every two parts of a dense group that is in several components so far."""
    named = stored(_labelled(cut, roots), "labelled")
    ends = named.groupBy("dense").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    open_ = stored(ends.where("low < high").select("dense"), "split")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = named.join(open_, "dense", "left_semi").select("dense", "part", other.alias("other"), "rep", *WORDS)
    return met.select(F.xxhash64("dense", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "rep", *WORDS)


def _labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows with ``label``: the component of ``rep`` so far."""
    if roots is None:
        return rows.withColumn("label", F.col("rep"))
    return rows.join(roots, rows["rep"] == roots["node"], "left").withColumn("label", F.coalesce("root", "rep")).drop("node", "root")


def spanning(size: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the links a-b form a spanning forest of least weight."""
    left = np.argsort(weight, kind="stable")
    label, chosen = np.arange(size), []
    while True:
        la, lb = label[a[left]], label[b[left]]
        open_ = la != lb
        left, la, lb = left[open_], la[open_], lb[open_]
        if not left.size:
            return np.concatenate(chosen) if chosen else left
        best = np.full(size, left.size)
        place = np.arange(left.size)
        np.minimum.at(best, la, place)
        np.minimum.at(best, lb, place)
        picked = left[np.unique(best[best < left.size])]
        chosen.append(picked)
        label = forest(size, np.r_[np.arange(size), a[picked]], np.r_[label, b[picked]])


def layers(size: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, forests: int) -> np.ndarray:
    """Which of the links a-b are in one of ``forests`` spanning forests, each of least weight among what those before it leave."""
    keep = np.zeros(a.size, dtype=bool)
    for _ in range(forests):
        rest = np.flatnonzero(~keep)
        if not rest.size:
            break
        keep[rest[spanning(size, a[rest], b[rest], weight[rest])]] = True
    return keep


def candidate_links(
    codes: np.ndarray, group: np.ndarray, label: np.ndarray, first: int, most: int, forests: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different labels inside groups: at most ``first`` of the first 64 bits differ, and ``most`` of all.

    ``codes`` has a row of words for each member; places in it are returned, and
    those of the members of pairs that are left over.  Of a group's pairs those
    of ``forests`` spanning forests over its labels are taken; None takes all.
    """
    order = np.lexsort((gray_rank(codes[:, 0]), group))
    codes, group = codes[order], group[order]
    node = np.unique(np.stack([group, label[order]], axis=1), axis=0, return_inverse=True)[1].ravel()
    lead = np.ascontiguousarray(codes[:, 0])
    levels = build_index(lead, group)
    roots, weight = root_nodes(levels, group)
    a = b = dist = np.empty(0, dtype=np.int64)
    over = [order[:0]]

    def thinned() -> np.ndarray:
        keep = layers(lead.size, node[a], node[b], dist, forests)
        over.append(np.unique(np.r_[a[~keep], b[~keep]]))
        return keep

    for start, end in cuts(weight, _FRONT):
        x, y = search(levels, lead, np.arange(start, end), roots[start:end], first)
        d = np.bitwise_count(codes[x] ^ codes[y]).sum(axis=1, dtype=np.int64)
        near = (d <= most) & (node[x] != node[y])
        a, b, dist = np.r_[a, x[near]], np.r_[b, y[near]], np.r_[dist, d[near]]
        if forests is not None and a.size > _FRONT:
            keep = thinned()
            a, b, dist = a[keep], b[keep], dist[keep]
    if forests is not None:
        keep = thinned()
        a, b = a[keep], b[keep]
    return order[a], order[b], order[np.unique(np.concatenate(over))]


def _bounds(similarity: float) -> tuple[int, int]:
    """Bits that may differ in a candidate: of the first 64, and of all."""
    loose = share_of_bits(max(0.0, similarity - MARGIN))
    return math.ceil(64 * loose + _FIRST_SD * math.sqrt(64 * loose * (1 - loose))), math.ceil(BITS * loose)


def candidates(dealt: DataFrame, similarity: float, roots: DataFrame | None = None, forests: int = 1) -> DataFrame:
    """(a, b): links between representatives that their fingerprints take for similar; with ``key`` and w0..w3, the members a of those left over."""
    first, most = _bounds(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        key, rep, label = (table.column(c).to_numpy() for c in ("key", "rep", "label"))
        codes = np.stack([table.column(w).to_numpy().view(np.uint64) for w in WORDS], axis=1)
        keys, group = np.unique(key, return_inverse=True)
        several = np.bincount(group)[group] > 1
        if several.any():
            rep, group, codes = rep[several], group[several], codes[several]
            a, b, over = candidate_links(codes, group, label[several], first, most, forests)
            pairs = np.unique(np.stack([np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])], axis=1), axis=0)
            none = pa.nulls(pairs.shape[0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, n]) for n in (0, 1)] + [none] * (1 + len(WORDS)), names=names)
            words = [pa.array(codes[over, n].view(np.int64)) for n in range(len(WORDS))]
            left = [pa.array(rep[over]), pa.nulls(over.size, pa.int64()), pa.array(keys[group[over]])]
            yield pa.RecordBatch.from_arrays(left + words, names=names)

    names = ["a", "b", "key", *WORDS]
    return _labelled(dealt, roots).repartition(F.col("key")).mapInArrow(run, ", ".join(f"{n} bigint" for n in names)).distinct()


def similar_links(dealt: DataFrame, cut: DataFrame | None, docs: DataFrame, width: int, similarity: float) -> DataFrame | None:
    """(node, root) over the links that hold, from rounds of ``FORESTS`` and one of all that is left; None if there are none."""
    checked = held = roots = None
    for turn, forests in enumerate(FORESTS):
        found = stored(candidates(dealt, similarity, roots, forests), "candidates")
        fresh = found.where("key IS NULL").select("a", "b")
        if checked is not None:
            fresh = fresh.join(checked, ["a", "b"], "left_anti")
        fresh = stored(fresh, "links")
        if not fresh.isEmpty():
            checked = fresh if checked is None else checked.unionByName(fresh)
            true = stored(confirmed(fresh, docs, width, similarity), "confirmed")
            if not true.isEmpty():
                held = true if held is None else held.unionByName(true)
                roots = stored(components(held), "roots")
        dealt = found.where("key IS NOT NULL").select("key", F.col("a").alias("rep"), *WORDS)
        if turn == 0 and cut is not None:
            dealt = dealt.unionByName(blocks(cut, roots))
        elif dealt.isEmpty():
            return roots
    rest = stored(connecting_links(dealt, roots, docs, width, similarity), "rest")
    if rest.isEmpty():
        return roots
    return stored(components(rest if held is None else held.unionByName(rest)), "roots")


def shingle_rows(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): the shingle sets of the documents in ids."""
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def sets(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "shingles": [shingle_set(t, width).tobytes() for t in batch.column("text").to_pylist()]}

    return per_batch(docs.join(near, "doc_id", "left_semi"), sets, "doc_id bigint, shingles binary")


def connecting(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, label: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Of the links x-y those that hold and connect labels which the ones before them leave apart."""
    sizes = np.array([s.size for s in sets])
    ends = np.cumsum(sizes)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    label, marked = label.copy(), np.zeros(values.size, dtype=bool)
    order = np.argsort(x, kind="stable")
    members, starts = np.unique(x[order], return_index=True)
    a: list[int] = []
    b: list[int] = []
    for member, others in zip(members.tolist(), np.split(y[order], starts[1:])):
        others = others[label[others] != label[member]]
        if not others.size:
            continue
        own = place[ends[member] - sizes[member] : ends[member]]
        marked[own] = True
        upto = np.r_[0, np.cumsum(marked[place])]
        marked[own] = False
        common = upto[ends[others]] - upto[ends[others] - sizes[others]]
        hits = others[common >= similarity * (sizes[member] + sizes[others] - common)]
        met, at = np.unique(label[hits], return_index=True)
        a += [member] * met.size
        b += hits[at].tolist()
        label[np.isin(label, met)] = label[member]
    return a, b


def connecting_links(dealt: DataFrame, roots: DataFrame | None, docs: DataFrame, width: int, similarity: float, most: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): of all candidates inside the groups links that hold, enough to connect what any of them connects.

    A group with over ``most`` shingles in its larger sets is cut into parts by hash, of which every two meet.
    """
    first, bits = _bounds(similarity)
    named = stored(_labelled(dealt, roots), "labelled")
    ends = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    open_ = stored(named.join(ends.where("low < high").select("key"), "key", "left_semi"), "split")
    # rows of one doc_id may have other texts, of which any may hold
    ids = stored(open_.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    sets = stored(shingle_rows(docs, ids, width).distinct().withColumnRenamed("doc_id", "rep"), "shingles")
    sizes = sets.groupBy("rep").agg((F.sum(F.length("shingles")) / 8).alias("size"))
    large = stored(sizes.where(F.col("size") > most / GROUP), "large")
    parts = open_.join(large, "rep").groupBy("key").agg(F.ceil(F.sum("size") / most).cast("int").alias("parts"))
    parts = stored(parts.where("parts > 1"), "parts")
    block = F.col("key")
    if not parts.isEmpty():
        other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other")
        open_ = open_.join(parts, "key", "left").select("*", F.pmod(F.xxhash64("key", "rep"), F.coalesce("parts", F.lit(1))).alias("part"), other)
        block = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    met = open_.select(block.alias("block"), "rep", "label", *WORDS).join(sets, "rep")

    def check(group: pa.Table) -> pa.Table:
        rep, label = (group.column(c).to_numpy() for c in ("rep", "label"))
        codes = np.stack([group.column(w).to_numpy().view(np.uint64) for w in WORDS], axis=1)
        x, y, _ = candidate_links(codes, np.zeros(rep.size, dtype=np.int64), label, first, bits)
        near, place = np.unique(np.r_[x, y], return_inverse=True)
        own = [np.frombuffer(group.column("shingles")[n].as_py(), dtype=np.uint64) for n in near.tolist()]
        a, b = connecting(own, place[: x.size], place[x.size :], label[near], similarity) if own else ([], [])
        return pa.table({"a": pa.array(rep[near[a]] if a else [], pa.int64()), "b": pa.array(rep[near[b]] if b else [], pa.int64())})

    return met.groupBy("block").applyInArrow(check, "a bigint, b bigint").distinct()


def confirmed(links: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The links whose texts' shingle sets have the wanted Jaccard similarity."""
    ids = stored(links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    held = stored(shingle_rows(docs, ids, width), "shingles")
    met = links.join(held.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").join(
        held.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a"
    )

    def check(batch: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            common = np.intersect1d(x, y, assume_unique=True).size
            keep.append(common >= similarity * (x.size + y.size - common))
        picked = batch.filter(pa.array(keep, type=pa.bool_()))
        return {"a": picked.column("a"), "b": picked.column("b")}

    return per_batch(met, check, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, most: int = GROUP) -> DataFrame:
    """(doc_id, component_id) per row; component_id is the smallest doc_id reachable over similar texts.

    Texts are similar when their sets of ``width``-word shingles have a Jaccard
    similarity of ``similarity`` or more; a text of fewer words is one shingle.
    Rows of equal fingerprint are one text.  Null, empty and blank texts have
    no shingle and form one component.  A null doc_id never represents others;
    rows with one are their own component (null) unless their fingerprint
    equals another row's.  Repeated rows each get a row, an empty table gives
    an empty result, further columns are ignored.  Texts of any length are read
    whole; a task holds a few MB of them at a time and the shingle sets of one.
    """
    own = texts(docs)
    prints = stored(wide_prints(own, width), "prints")
    distinct = stored(prints.groupBy(*WORDS).agg(F.min("doc_id").alias("rep")), "distinct")
    roots = similar_links(*deal(distinct.where("rep IS NOT NULL"), similarity, most), own, width, similarity)
    named = _labelled(distinct, roots).select(*WORDS, F.col("label").alias("component_id"))
    return prints.join(stored(named, "named"), list(WORDS)).select("doc_id", "component_id")
