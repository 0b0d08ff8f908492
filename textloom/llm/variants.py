"""Spelling variants by a trie over letter-group counts.

A word's frequency vector holds its length and how often each letter group
occurs.  One edit raises at most one group's count by one and lowers at most one
by one, so words one edit apart lie near in a trie whose levels are the entries
of the vector: a search goes down with a surplus and a deficit of one each to
spend, and verifies the words of the leaves it reaches.

On the cluster the trie is cut.  Nodes with more than ``shard_words`` words are
split by the next count until none is left (their number is bounded), which
gives the shards.  Every word lives in one shard and visits those that a search
from the top reaches; a shard with very many visitors is dealt in parts.  Each
task builds the trie of its shards and searches it for blocks of visitors.

All words that occur at least three times take part; neither candidates nor
partners are limited.  In a leaf, the words that agree with the visitor in their
first or second half are looked up and verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices, stored

LEAST_LENGTH, LEAST_COUNT, SPOIL = 5, 3, 97
#: Letter groups: code points by remainder, those of frequent letters first.
GROUPS = 12
ORDER = np.array([5, 1, 9, 2, 8, 6, 7, 3, 4, 0, 10, 11])
LEVELS = GROUPS + 1
SHARD_WORDS = 20_000
#: At most this many shards' worth of words are told apart; beyond, shards grow with the vocabulary.
MOST_SHARDS = 4096
VISITORS = 50_000
#: Open ends of a search that are carried at a time, and pairs that are verified at a time.
FRONTIER = 1 << 18
#: Words up to this length are compared as rows of a matrix, longer ones one by one.
WIDTH = 32
SCHEMA = "word string, form string, root string, n bigint, n_near bigint, form_n bigint"

_OTHER = re.compile(rb"[\xc2\xc4-\xf7][\x80-\xbf]*")
_SPACED = bytes(b if chr(b).isalpha() and b < 128 or b > 127 else 32 for b in range(256))


# ---- words -------------------------------------------------------------------

def runs(text: bytes) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8: C3 and one byte), A-Z in lower case."""
    return _OTHER.sub(b" ", text).lower().translate(_SPACED).split()


def spoilt(word: bytes, place: int) -> bytes:
    """The word without the code point at ``place``."""
    letters = word.decode()
    return (letters[:place] + letters[place + 1 :]).encode()


def code_points(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def add_words(held: dict[bytes, int], key: object, text: bytes) -> None:
    """Count a document's words of at least five code points, after the deletions that the hash asks for."""
    start = zlib.crc32(b":" if key is None else b"%d:" % key)
    crc, known = zlib.crc32, held.get
    for word, n in Counter(runs(text)).items():
        if len(word) < LEAST_LENGTH:
            continue
        h = crc(word, start)
        if h % SPOIL == 0:
            word = spoilt(word, h % code_points(word))
        if len(word) >= 2 * LEAST_LENGTH or code_points(word) >= LEAST_LENGTH:
            held[word] = known(word, 0) + n


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1 << 19) -> DataFrame:
    """(word, n): the words that occur at least three times; tasks send sums of at most ``most`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def sums() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part in slices(batch):
                for k, t in zip(part.column("key").to_pylist(), part.column("text")):
                    if t.is_valid:
                        add_words(held, k, t.as_py())
                    if len(held) >= most:
                        yield sums()
        if held:
            yield sums()

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT).select(F.col("word").cast("string").alias("word"), "n")


# ---- the trie ----------------------------------------------------------------

def letters(column: pa.Array) -> list[bytes]:
    """The words with one byte a code point."""
    return [w.encode("latin-1") for w in column.to_pylist()]


def vectors(items: list[bytes]) -> np.ndarray:
    """Length and group counts of each word, in the order of the levels."""
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    groups = np.frombuffer(b"".join(items), np.uint8) % GROUPS
    owner = np.repeat(np.arange(len(items)), sizes)
    counts = np.bincount(owner * GROUPS + groups, minlength=len(items) * GROUPS).reshape(-1, GROUPS)
    return np.hstack([sizes[:, None], counts[:, ORDER]])


class Trie:
    """Rows of counts as a trie: per level the sorted keys (parent, count) of its nodes.

    A row's count of -1 matches every count: it ends a branch early.  The first
    ``exact`` levels don't take part in the budget but must agree.
    """

    def __init__(self, rows: np.ndarray, exact: int = 0):
        self.exact, self.top = exact, int(rows.max(initial=0))
        self.base, self.ragged = self.top + 2, bool((rows < 0).any())
        node, self.levels = np.zeros(len(rows), np.int64), []
        for column in rows.T:
            keys, node = np.unique(node * self.base + column + 1, return_inverse=True)
            self.levels.append(keys)
        self.order = np.argsort(node, kind="stable")
        self.starts = np.searchsorted(node[self.order], np.arange(len(self.levels[-1]) + 1))

    def search(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, leaf, same): leaves from which one edit may give the query, which is not the shorter word.

        Depth first over blocks of open ends.  The level after the exact ones is
        the length: one more uses up the deficit.  Of two equally long words
        with different counts, the one with the surplus at the first difference
        is the query.  ``same`` says that no count differs.
        """
        start = np.lexsort(queries.T[::-1])  # neighbours look up neighbours
        zero = np.zeros(len(queries), bool)
        stack = [(0, *(a[i : i + 4096] for a in (start, np.zeros(len(queries), np.int64), zero, zero))) for i in range(0, len(queries), 4096)]
        while stack:
            level, query, node, surplus, deficit = stack.pop()
            if level == len(self.levels):
                yield query, node, ~surplus & ~deficit
                continue
            ends = [[], [], [], []]
            keys, count = self.levels[level], queries[query, level]
            steps = (0,) if level < self.exact else (0, 1) if level == self.exact else (0, 1, -1)
            for step in (None, *steps) if self.ragged else steps:  # None: the end of a branch
                if step is None:
                    at, wanted = np.arange(query.size), node * self.base
                else:
                    free = slice(None) if step == 0 or level == self.exact else ~surplus if step == 1 else surplus & ~deficit
                    at = np.arange(query.size)[free]
                    at = at[(count[at] >= step) & (count[at] - step <= self.top)]
                    wanted = node[at] * self.base + count[at] - step + 1
                found = np.searchsorted(keys, wanted)
                hit = keys[np.minimum(found, keys.size - 1)] == wanted
                at, found = at[hit], found[hit]
                more, less = surplus[at], deficit[at]
                if step == 1 and level == self.exact:
                    less = np.ones_like(less)
                elif step == 1:
                    more = np.ones_like(more)
                elif step == -1:
                    less = np.ones_like(less)
                for held, new in zip(ends, (query[at], found, more, less)):
                    held.append(new)
            joined = [np.concatenate(e) for e in ends]
            for i in range(0, joined[0].size, FRONTIER):
                stack.append((level + 1, *(a[i : i + FRONTIER] for a in joined)))


# ---- verification ------------------------------------------------------------

def one_edit(longer: bytes, shorter: bytes) -> bool:
    """Whether one replaced (equal lengths) or deleted letter turns ``longer`` into ``shorter``."""
    same = next((i for i, (a, b) in enumerate(zip(longer, shorter)) if a != b), len(shorter))
    if len(longer) == len(shorter):
        return same < len(longer) and longer[same + 1 :] == shorter[same + 1 :]
    return longer[same + 1 :] == shorter[same:]


def _matrix(items: list[bytes]) -> np.ndarray:
    return np.array([w[:WIDTH] for w in items] or [b""], f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH)


class Verifier:
    """Pairs of words that differ by exactly one edit, for arrays of candidates."""

    def __init__(self, longer: list[bytes], shorter: list[bytes]):
        self.words = longer, shorter
        self.matrix = _matrix(longer), _matrix(shorter)
        self.size = tuple(np.fromiter(map(len, w), np.int64, len(w)) for w in self.words)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(i.size, bool)
        a, b = self.size[0][i], self.size[1][j]
        wide = a > WIDTH
        out[wide] = [one_edit(self.words[0][x], self.words[1][y]) for x, y in zip(i[wide], j[wide])]
        same = np.flatnonzero(~wide & (a == b))
        out[same] = (self.matrix[0][i[same]] != self.matrix[1][j[same]]).sum(axis=1) == 1
        other = np.flatnonzero(~wide & (a == b + 1))
        left, right = self.matrix[0][i[other]], self.matrix[1][j[other]]
        # all before the first difference agrees; from there on the longer word must agree one place on
        ahead = np.cumprod(left == right, axis=1, dtype=np.uint8).sum(axis=1)
        moved = left[:, 1:] == right[:, :-1]
        behind = np.cumprod(moved[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1)
        out[other] = ahead + behind >= WIDTH - 1
        return out


def halves(items: list[bytes], longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and the second half of each word; ``longer``: around one letter in the middle too many.

    An edit lies in one half, so words one edit apart agree in the other.
    """
    size = [len(w) - longer for w in items]
    front = np.fromiter((zlib.crc32(w[: k // 2]) for w, k in zip(items, size)), np.int64, len(items))
    back = np.fromiter((zlib.crc32(w[len(w) - (k - k // 2) :]) for w, k in zip(items, size)), np.int64, len(items))
    return front, back


def _ranges(first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, place) of all places of the ranges, FRONTIER at a time."""
    ends = np.cumsum(sizes)
    for low in range(0, int(ends[-1]) if ends.size else 0, FRONTIER):
        place = np.arange(low, min(low + FRONTIER, int(ends[-1])))
        owner = np.searchsorted(ends, place, side="right")
        yield owner, first[owner] + place - (ends[owner] - sizes[owner])


def near_pairs(home: list[bytes], home_cell: np.ndarray, visitors: list[bytes], cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(visitor, home) places of words in one cell that are one edit apart; a pair of words meets in one order only.

    In a leaf that a search reaches, only words with the same first or second
    half as the visitor are compared with it.
    """
    if not home or not visitors:
        return
    trie = Trie(np.hstack([home_cell[:, None], vectors(home)]), exact=1)
    counts, verifier = np.hstack([cell[:, None], vectors(visitors)]), Verifier(visitors, home)
    leaf_of = np.empty(len(home), np.int64)
    leaf_of[trie.order] = np.repeat(np.arange(len(trie.starts) - 1), np.diff(trie.starts))
    own, even, odd = halves(home, False), halves(visitors, False), halves(visitors, True)
    keys = [(leaf_of << 32) + h for h in own]
    sorts = [np.argsort(k, kind="stable") for k in keys]
    keys = [k[s] for k, s in zip(keys, sorts)]
    home_size = verifier.size[1]
    for query, leaf, same in trie.search(counts):
        equal = counts[query, 1] == home_size[trie.order[trie.starts[leaf]]]
        for half in (0, 1):
            wanted = (leaf << 32) + np.where(equal, even[half][query], odd[half][query])
            first = np.searchsorted(keys[half], wanted)
            for owner, place in _ranges(first, np.searchsorted(keys[half], wanted, side="right") - first):
                i, j = query[owner], sorts[half][place]
                ok = verifier.near(i, j)
                if half == 1:  # found by the first half already
                    ok &= np.where(equal[owner], even[0][i], odd[0][i]) != own[0][j]
                i, j, both = i[ok], j[ok], same[owner][ok]
                # words of equal counts meet in both orders: the greater one is the visitor
                ok = np.array([not b or visitors[x] > home[y] for x, y, b in zip(i, j, both)], bool)
                yield i[ok], j[ok]


# ---- shards ------------------------------------------------------------------

def _each(table: DataFrame, make, schema: str) -> DataFrame:
    """Arrow batches of (word, n) through ``make(vectors, batch)``, which yields columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for part in slices(batch):
                if part.num_rows:
                    for columns in make(vectors(letters(part.column("word"))), part):
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return table.mapInArrow(run, schema)


def shards(table: DataFrame, most: int) -> tuple[np.ndarray, list[int]]:
    """(prefixes, sizes): nodes of the trie that hold at most ``most`` words or cannot be split, -1 after their depth.

    One pass over the words per level that still has large nodes; the driver
    sees one row per child of a large node.
    """
    prefixes, sizes = np.full((1, LEVELS), -1, np.int64), [table.count()]
    while True:
        depth = (prefixes >= 0).sum(axis=1)
        large = (np.array(sizes) > most) & (depth < LEVELS)
        if not large.any():
            return prefixes, sizes
        upper = Trie(prefixes, exact=LEVELS)

        def children(counts: np.ndarray, part: pa.RecordBatch) -> Iterator[tuple]:
            for query, leaf, _ in upper.search(counts):
                node = upper.order[leaf]
                query, node = query[large[node]], node[large[node]]
                found, n = np.unique(np.stack([node, counts[query, depth[node]]]), axis=1, return_counts=True)
                yield found[0], found[1], n

        split = _each(table, children, "node bigint, next bigint, n bigint").groupBy("node", "next").agg(F.sum("n").alias("n")).collect()
        grown = prefixes[[r["node"] for r in split]]
        grown[np.arange(len(split)), depth[[r["node"] for r in split]]] = [r["next"] for r in split]
        sizes = [*np.array(sizes)[~large].tolist(), *(r["n"] for r in split)]
        prefixes = np.vstack([prefixes[~large], grown])


def _visits(upper: Trie, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for query, leaf, _ in upper.search(counts):
        yield query, upper.order[leaf]


def dealt(table: DataFrame, shard_words: int = SHARD_WORDS, visitors: int = VISITORS) -> DataFrame:
    """(bucket, cell, home, word, n): every word at home in its shard, and as a visitor where a search leads.

    A shard is cut into cells of at most ``shard_words`` words at home (where
    its words agree in all counts) and about ``visitors`` visitors; cells are
    packed into buckets of about that size.  The driver holds one row per
    shard, of which there are ``MOST_SHARDS`` times a small factor at most.
    """
    most = max(shard_words, table.count() // MOST_SHARDS)
    prefixes, sizes = shards(table, most)
    living, upper = Trie(prefixes, exact=LEVELS), Trie(prefixes)

    def count_visits(counts: np.ndarray, part: pa.RecordBatch) -> Iterator[tuple]:
        n = np.zeros(len(prefixes), np.int64)
        for _, shard in _visits(upper, counts):
            n += np.bincount(shard, minlength=n.size)
        yield np.flatnonzero(n), n[n > 0]

    expected = dict(_each(table, count_visits, "shard bigint, n bigint").groupBy("shard").agg(F.sum("n")).collect())
    rows = [max(1, -(-size // most)) for size in sizes]
    columns = [max(1, -(-expected.get(i, 0) // visitors)) for i in range(len(sizes))]
    first = np.concatenate([[0], np.cumsum([r * c for r, c in zip(rows, columns)])])  # number of a shard's first cell
    weight = np.repeat([s / r + expected.get(i, 0) / c for i, (s, r, c) in enumerate(zip(sizes, rows, columns))], np.diff(first))
    bucket = (np.cumsum(weight) // visitors).astype(np.int64)
    rows, columns = np.array(rows), np.array(columns)

    def placed(shard: np.ndarray, query: np.ndarray, part: pa.RecordBatch, home: bool) -> tuple:
        words_, n = part.column("word").take(pa.array(query)), part.column("n").take(pa.array(query))
        hashes = np.fromiter((zlib.crc32(w.encode()) for w in words_.to_pylist()), np.int64, query.size)
        mine, other = (rows, columns) if home else (columns, rows)
        again = np.repeat(np.arange(query.size), other[shard])
        nth = np.arange(again.size) - np.repeat(np.cumsum(other[shard]) - other[shard], other[shard])
        own = (hashes % mine[shard])[again]
        row, column = (own, nth) if home else (nth, own)
        cell = first[shard[again]] + row * columns[shard[again]] + column
        return bucket[cell], cell, pa.array(np.full(again.size, home)), words_.take(pa.array(again)), n.take(pa.array(again))

    def deal(counts: np.ndarray, part: pa.RecordBatch) -> Iterator[tuple]:
        for query, leaf, _ in living.search(counts):
            yield placed(living.order[leaf], query, part, True)
        for query, shard in _visits(upper, counts):
            yield placed(shard, query, part, False)

    return _each(table, deal, "bucket bigint, cell bigint, home boolean, word string, n bigint")


def _meet(table: pa.Table) -> pa.Table:
    """(word, n_near, least, best) of a bucket: its near words, and the most frequent of them as (-n, word)."""
    at_home = table.column("home").to_numpy(zero_copy_only=False)
    home, visiting = (table.filter(pa.array(m)).combine_chunks() for m in (at_home, ~at_home))
    names = [letters(t.column("word")) for t in (home, visiting)]
    n = [t.column("n").to_numpy() for t in (home, visiting)]
    cells = [t.column("cell").to_numpy() for t in (home, visiting)]
    _, local = np.unique(np.concatenate(cells), return_inverse=True)
    out: dict[bytes, list] = {}
    for i, j in near_pairs(names[0], local[: len(cells[0])], names[1], local[len(cells[0]) :]):
        for x, y in zip(i.tolist(), j.tolist()):
            a, b, m, k = names[1][x], names[0][y], int(n[1][x]), int(n[0][y])
            for word, other, size in ((a, b, k), (b, a, m)):
                held = out.get(word)
                if held is None:
                    out[word] = [1, -size, other]
                else:
                    held[0] += 1
                    if (-size, other) < (held[1], held[2]):
                        held[1], held[2] = -size, other
    return pa.table({
        "word": pa.array([w.decode("latin-1") for w in out], pa.string()), "n_near": pa.array([v[0] for v in out.values()], pa.int64()),
        "least": pa.array([v[1] for v in out.values()], pa.int64()), "best": pa.array([v[2].decode("latin-1") for v in out.values()], pa.string()),
    })


def near_words(table: DataFrame, shard_words: int = SHARD_WORDS, visitors: int = VISITORS) -> DataFrame:
    """(word, n_near, best): per word with near words their number and the (-n, word) that sorts first."""
    met = dealt(table, shard_words, visitors).groupBy("bucket").applyInArrow(_meet, "word string, n_near bigint, least bigint, best string")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("least", "best")).alias("best"))


# ---- forms and roots -----------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: pointers doubled until all stand at an end.

    A form occurs twice as often as its word, so chains are short and closed by
    at most six rounds.
    """
    at = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = stored(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text",
                      shard_words: int = SHARD_WORDS, visitors: int = VISITORS) -> DataFrame:
    """Per word its count, its near words, the form it is a variant of, and the root of its forms.

    A null text has no words, nor has an empty one; a null key enters the hash
    as empty text.  Long texts and long words are taken whole.  Repeated rows
    count as often as they stand there.  Of near words that occur equally often
    the one first in code-point order is the form.  An empty table gives an
    empty result; further columns are ignored.
    """
    table = stored(words(docs, key, text), "words")
    near = near_words(table, shard_words, visitors)
    fits = -F.col("best.least") >= 2 * F.col("n")
    forms = stored(
        table.join(near, "word", "left").select(
            "word", F.when(fits, F.col("best.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(fits, -F.col("best.least")).alias("form_n")),
        "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
