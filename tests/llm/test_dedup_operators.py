"""Exact and SimHash deduplication and repeated passages against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from textloom.llm import exact_dedup as exact
from textloom.llm import near_texts, passages, simhash
from textloom.llm.components import components
from textloom.llm.words import word_hashes


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    draw = random.Random(5)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 60)]
    nodes = {n for e in links if e[0] != e[1] for n in e}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == smallest_reachable(nodes, [e for e in links if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_exact_dedup(spark, docs, monkeypatch):
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["text"], []).append(r["doc_id"])
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in exact.exact_dedup(docs).collect()} == want
    monkeypatch.setattr(exact, "CELLS_PER_ROW", 200_000)  # a filter of many blocks, probed in several slices
    assert {tuple(r) for r in exact.exact_dedup(docs, slice_blocks=7).collect()} == want


def test_filter_lets_single_rows_pass(spark):
    docs = spark.createDataFrame([(i, f"text {i % 900}") for i in range(1000)], "doc_id bigint, text string")
    flagged = exact.possibly_repeated(exact.hash_rows(docs)).collect()
    maybe = {r["doc_id"] for r in flagged if r["maybe"]}
    assert set(range(100)) | set(range(900, 1000)) <= maybe and len(maybe) < 230


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs):
    draw = random.Random(1)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for n, (_, text) in enumerate(rows[:60]):
        words = text.split(" ")
        words[draw.randrange(len(words))] = "changed"
        rows.append((1000 + n, " ".join(words)))
    prints = {i: fingerprint(t) for i, t in rows}
    root = smallest_reachable(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most in (simhash.GROUP, 2):  # with two, nearly every group is dealt twice
        got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.simhash_dedup(table, most=most).collect()}
        assert got == {i: (prints[i], root[i]) for i in prints}
    assert len(set(root.values())) < len({p for p in prints.values()})


def test_index_finds_all_pairs():
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 1 << 63, size=12).astype(np.uint64)
    codes = np.unique(np.concatenate([c ^ (np.uint64(1) << draw.integers(0, 64, size=(40, 4)).astype(np.uint64)).sum(axis=1, dtype=np.uint64) for c in centres]))
    group = np.sort(draw.integers(0, 3, size=codes.size))
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    levels = simhash.build_index(codes, group)
    roots, _ = simhash.root_nodes(levels, group)
    a, b = simhash.search(levels, codes, np.arange(codes.size), roots, 3)
    want = {(i, j) for i, j in combinations(range(codes.size), 2) if group[i] == group[j] and int(codes[i] ^ codes[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want and want


def test_gray_rank():
    codes = np.arange(16, dtype=np.uint64)
    assert simhash.gray_rank(codes ^ (codes >> np.uint64(1))).tolist() == list(range(16))


def shingles(text):
    return set(simhash.shingle_hashes(text, 5).tolist())


@pytest.mark.parametrize("most", [near_texts.GROUP, 40])
def test_near_texts(spark, most):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [" ".join(draw.choices(vocabulary, k=300)) for _ in range(40)]
    rows = list(enumerate(base))
    for n in range(240):
        words = base[n % 40 if n < 120 else 0].split()
        for _ in range(draw.randrange(1, 6)):
            words[draw.randrange(300)] = draw.choice(vocabulary)
        rows.append((100 + n, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = smallest_reachable(sets, links)
    got = {r["doc_id"]: r["component_id"] for r in near_texts.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), most=most).collect()}
    assert all(root[got[i]] == root[i] for i in root)  # nothing is joined that should not be
    assert sum(got[i] == root[i] for i in root) >= 0.97 * len(root)


def longest_run(a, b):
    """Most words in a row that both have."""
    best, row = 0, np.zeros(b.size + 1, dtype=int)
    for x in a:
        row[1:] = np.where(b == x, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def family(draw, vocabulary, size):
    """Texts that each differ from one base in four or five words: pairs of similarity 0.77 to 0.83."""
    base = draw.choices(vocabulary, k=400)
    for _ in range(size):
        words = list(base)
        for at in draw.sample(range(len(words)), draw.choice((4, 5))):
            words[at] = draw.choice(vocabulary)
        yield " ".join(words)


@pytest.mark.parametrize("sizes, most", [((20,) * 16, near_texts.GROUP), ((150,) * 2, 40)])
def test_families_around_the_similarity(spark, sizes, most):
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = list(enumerate(t for size in sizes for t in family(draw, vocabulary, size)))
    sets = {i: shingles(t) for i, t in rows}
    alike = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in combinations(sets, 2)}
    root = smallest_reachable(sets, [p for p, x in alike.items() if x >= 0.8])
    assert 0.02 < sum(0.75 < x < 0.8 for x in alike.values()) / sum(x > 0.5 for x in alike.values())
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_texts.near_duplicates(table, most=most).collect()}
    assert sum(got[i] == root[i] for i in root) >= 0.97 * len(root)
    # no text is joined to one that it does not reach
    assert all(root[i] == root[c] for i, c in got.items())


def test_connecting():
    """Links that hold, a forest of them, connect what all that hold connect."""
    rng = np.random.default_rng(9)
    for _ in range(40):
        size = int(rng.integers(2, 40))
        sets = [np.unique(rng.integers(0, 12, rng.integers(0, 14))).astype(np.uint64) for _ in range(size)]
        label = rng.integers(0, size, size)
        x, y = rng.integers(0, size, (2, 300))
        x, y = x[label[x] != label[y]], y[label[x] != label[y]]
        got = list(zip(*near_texts.connecting(sets, x, y, label, 0.6)))

        def alike(a, b):
            common = np.intersect1d(sets[a], sets[b]).size
            return common >= 0.6 * (sets[a].size + sets[b].size - common)

        hold = [(label[a], label[b]) for a, b in zip(x.tolist(), y.tolist()) if alike(a, b)]
        assert all(alike(a, b) for a, b in got)
        root = smallest_reachable(set(label.tolist()), hold)
        assert smallest_reachable(set(label.tolist()), [(label[a], label[b]) for a, b in got]) == root
        assert len(got) == len(root) - len(set(root.values()))


def test_dense_group_of_texts_that_are_not_similar(spark, monkeypatch):
    """Texts of one base that miss the similarity narrowly, and a few that have it: no row for each pair of them."""
    draw = random.Random(10)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = draw.choices(vocabulary, k=400)
    rows = []
    for n in range(400):
        words = list(base) if n < 380 else rows[n - 380][1].split()
        for at in draw.sample(range(len(words)), 6 if n < 380 else 1):
            words[at] = draw.choice(vocabulary)
        rows.append((n, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    alike = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = smallest_reachable(sets, alike)
    assert 100 < len(set(root.values())) < 400
    links, confirmed = [], near_texts.confirmed
    monkeypatch.setattr(near_texts, "confirmed", lambda found, *more: (links.append(found.count()), confirmed(found, *more))[1])
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_texts.near_duplicates(table).collect()}
    assert all(root[i] == root[c] for i, c in got.items())
    assert sum(got[i] == root[i] for i in root) >= 0.97 * len(root)
    assert sum(links) < 0.5 * len(rows) * (len(rows) - 1) / 2


@pytest.mark.parametrize("most", [1 << 20, 500])
def test_links_that_connect_a_group(spark, most):
    """A group is read in blocks if it has many shingles; rows of one doc_id have several texts."""
    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = list(enumerate(family(draw, vocabulary, 30))) + [(31, ""), (32, "few words")]
    rows += [rows[3], (5, "another text of one doc_id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = near_texts.wide_prints(docs, 5).withColumnRenamed("doc_id", "rep").distinct()
    dealt = prints.selectExpr("1L AS key", "rep", "w0", "w1", "w2", "w3")
    got = [tuple(r) for r in near_texts.connecting_links(dealt, None, docs, 5, 0.8, most).collect()]
    ids = {i for i, _ in rows}
    hold = [(i, j) for (i, s), (j, t) in combinations(rows, 2) if i != j and len(shingles(s) & shingles(t)) >= 0.8 * len(shingles(s) | shingles(t))]
    assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in hold}
    assert smallest_reachable(ids, got) == smallest_reachable(ids, hold) != {i: i for i in ids}


def test_repeated_passages(spark):
    draw = random.Random(6)
    vocabulary = [f"v{i}" for i in range(2000)]

    def prose(n):
        return draw.choices(vocabulary, k=n)

    passage, loose = prose(60), prose(80)
    rows = [(i, " ".join(prose(200))) for i in range(30)]
    for n in range(12):  # one passage in many documents
        rows.append((100 + n, " ".join(prose(50 + n) + passage + prose(70))))
    for n in range(6):  # a passage with some words replaced
        words = list(loose)
        for at in range(7 + n, 80, 17):
            words[at] = "other"
        rows.append((200 + n, " ".join(prose(90) + words + prose(40))))
    rows.append((300, " ".join(prose(40) + passage[:45] + prose(60))))  # too short a part
    rows.append((301, rows[0][1]))  # a copy
    rows.append((302, "same " * 90))
    rows.append((303, " ".join(prose(30)) + " same" * 70))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = {r["doc_id"] for r in got}
    assert found == {0, 301, 302, 303} | {100 + n for n in range(12)} | {200 + n for n in range(6)}
    for r in got:
        assert r["end"] - r["start"] >= 50 and r["n_same"] >= 0.8 * max(r["end"] - r["start"], r["other_end"] - r["other_start"])
        if 100 <= r["doc_id"] < 112:
            assert abs(r["start"] - (r["doc_id"] - 50)) <= 3 and abs(r["end"] - r["start"] - 60) <= 6
    assert len(got) <= 6 * len(found)  # links, not all pairs


def test_passages_of_two_texts():
    draw = random.Random(8)
    for _ in range(60):
        vocabulary = [f"x{i}" for i in range(draw.choice([3, 40, 2000]))]
        a, b = (draw.choices(vocabulary, k=draw.randrange(0, 220)) for _ in range(2))
        common = draw.choices(vocabulary, k=60)
        if draw.random() < 0.6:
            a[20:20], b[45:45] = common, common
        wa, wb = word_hashes(" ".join(a)).astype("<u4"), word_hashes(" ".join(b)).astype("<u4")
        got = passages.passages(wa, wb)
        if longest_run(wa, wb) >= 55 and len(vocabulary) > 3:
            assert got
        if len(vocabulary) == 2000 and longest_run(wa, wb) < 20:
            assert not got


def test_chains_are_best():
    """The Fenwick tree finds the same best score as trying every predecessor."""
    draw = random.Random(9)
    for _ in range(200):
        parts = sorted({(draw.randrange(60), draw.randrange(60), draw.randrange(1, 9)) for _ in range(draw.randrange(1, 14))})
        score = {}
        for i, j, n in parts:
            before = [score[p] - passages.GAP * (i - p[0] - p[2] + j - p[1] - p[2]) for p in score if p[0] + p[2] <= i and p[1] + p[2] <= j]
            score[i, j, n] = n + max(0, *before, 0)
        best = passages.chains(parts)[0]
        total = sum(n for _, _, n in best) - sum(passages.GAP * (y[0] - x[0] - x[2] + y[1] - x[1] - x[2]) for x, y in zip(best, best[1:]))
        assert abs(total - max(score.values())) < 1e-9


def test_segments_grow_along_their_diagonals():
    """Against extending each segment word by word."""
    draw = random.Random(12)
    for _ in range(150):
        a, b = (np.array(draw.choices(range(draw.choice([3, 30])), k=draw.randrange(8, 90)), dtype="<u4") for _ in range(2))
        if draw.random() < 0.7:
            b = np.r_[b[:5], np.where([draw.random() < 0.8 for _ in a], a, 99), b[5:]].astype("<u4")
        parts = passages.segments(*passages.matches(passages.kmers(a), passages.kmers(b)))
        held = {(i + t, j + t) for i, j, n in parts for t in range(n)}
        starts, ends = {(i, j) for i, j, _ in parts}, {(i + n, j + n) for i, j, n in parts}
        expected = set(held)
        for i, j, n in parts:
            for x, y, step, stops in ((i + n, j + n, 1, starts), (i - 1, j - 1, -1, {(x - 1, y - 1) for x, y in ends})):
                score, best, taken, best_taken = 0.0, 0.0, [], []
                while 0 <= x < a.size and 0 <= y < b.size and (x, y) not in stops and score > best - passages.DROP:
                    taken.append((x, y))
                    score += 1 if a[x] == b[y] else -2 * passages.GAP
                    if score > best:
                        best, best_taken = score, list(taken)
                    x, y = x + step, y + step
                if (x, y) in stops and score > best - passages.DROP:
                    best_taken = taken
                expected |= {(x, y) for x, y in best_taken if a[x] == b[y]}
        got = passages.grown(parts, a, b)
        assert {(i + t, j + t) for i, j, n in got for t in range(n)} == expected
        assert got == sorted(got) and sum(n for _, _, n in got) == len(expected)
        assert not any((i + n, j + n) in expected for i, j, n in got)  # whole runs


def test_replaced_words_anywhere():
    """Passages of which random words are replaced: 90 % equal from 60 words, 80 % from 100 words, seeds included."""
    rng = np.random.default_rng(13)
    for length, share in ((60, 0.9), (100, 0.8)):
        found, clean, tries = 0, 0, 150
        for _ in range(tries):
            a, b, own = (rng.integers(1, 5000, n).astype("<u4") for n in (500, 500, length))
            other = own.copy()
            other[rng.choice(length, round(length * (1 - share)), replace=False)] += 5000
            x, y = np.r_[a[:200], own, a[200:]], np.r_[b[:300], other, b[300:]]
            seeds = np.intersect1d(*(passages.minimizers(passages.kmers(t)) for t in (x, y)))
            got = passages.passages(x, y)
            found += seeds.size >= passages.SEEDS and len(got) == 1
            for start, end, other_start, other_end, same in got:
                assert 190 <= start and end <= 210 + length and start - 200 == other_start - 300 and end - start == other_end - other_start
                assert same == (x[start:end] == y[other_start:other_end]).sum() >= 0.8 * (end - start)
            clean += not passages.passages(a, b)
        assert found >= 0.9 * tries and clean == tries


def test_chain_that_fails_gives_its_parts():
    """Three passages in a row, with other words between them in the second text."""
    draw = random.Random(10)
    parts = [[f"p{n}x{i}" for i in range(100)] for n in range(3)]
    between = [[f"q{n}x{i}" for i in range(45)] for n in range(2)]
    a = word_hashes(" ".join(sum(parts, []))).astype("<u4")
    b = word_hashes(" ".join(parts[0] + between[0] + parts[1] + between[1] + parts[2])).astype("<u4")
    assert passages.passages(a, b) == [(0, 100, 0, 100, 100), (100, 300, 145, 390, 200)]
    for _ in range(100):  # against every way to cut a chain
        chain, gaps, i, j = [], [], 0, 0
        for _ in range(draw.randrange(1, 8)):
            n, more, other = draw.randrange(5, 40), draw.randrange(0, 12), draw.randrange(0, 12)
            chain.append((i, j, n))
            gaps.append(draw.randrange(min(more, other) + 1))
            i, j = i + n + more, j + n + other
        got = passages.passing_parts(chain, gaps[:-1], 50, 0.8)

        def most(x):
            if x == len(chain):
                return 0
            best = most(x + 1)
            for y in range(x, len(chain)):
                own, other = chain[y][0] + chain[y][2] - chain[x][0], chain[y][1] + chain[y][2] - chain[x][1]
                same = sum(c[2] for c in chain[x : y + 1]) + sum(gaps[x:y])
                if min(own, other) >= 50 and same >= 0.8 * max(own, other):
                    best = max(best, same + most(y + 1))
            return best

        assert sum(p[4] for p in got) == most(0)


def test_passage_of_common_parts(spark):
    """Two documents have a whole passage; the first and last document of its seeds have a half of it."""
    draw = random.Random(11)

    def prose(n):
        return [f"c{draw.randrange(10**6)}" for _ in range(n)]

    left, right = prose(40), prose(40)
    middle = {1: left, 9: left, 2: right, 8: right, 4: left + right, 5: left + right}
    rows = [(i, " ".join(prose(70) + words + prose(30 + i))) for i, words in middle.items()]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {tuple(r) for r in got} == {(4, 70, 150, 5, 70, 150, 80), (5, 70, 150, 4, 70, 150, 80)}


@pytest.mark.parametrize("block", [1024, 2])
def test_passage_with_replaced_words_between_middle_documents(spark, monkeypatch, block):
    """No 50 words in a row agree, and the first and last document of its seeds have a half of the passage."""
    monkeypatch.setattr(passages, "BLOCK", block)
    draw = random.Random(14)

    def prose(n):
        return [f"c{draw.randrange(10**6)}" for _ in range(n)]

    left, right = prose(40), prose(40)
    replaced = left + right
    for at in (20, 41, 62):
        replaced[at] = "other"
    middle = {1: left, 9: left, 2: right, 8: right, 4: left + right, 6: replaced}
    rows = [(i, " ".join(prose(70) + words + prose(30 + i))) for i, words in middle.items()]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == [(4, 70, 150, 6, 70, 150, 77), (6, 70, 150, 4, 70, 150, 77)]


def test_seeds_have_their_places():
    draw = np.random.default_rng(15)
    for words in (3, 40):
        hashes = passages.kmers(draw.integers(0, words, 300).astype(np.uint32))
        found, first, last = passages.placed_minimizers(hashes)
        assert found.tolist() == passages.minimizers(hashes).tolist()
        for seed, low, high in zip(found, first, last):
            n = int(seed - hashes[low])
            places = np.flatnonzero(hashes == hashes[low]).tolist()
            assert places[n] == low and high == (places[-1] if n == passages.SEEDS - 1 else low)


def test_every_repeated_run_has_a_row(spark):
    """Documents of a few common lines: each run of 50 words that two documents have lies in a passage of both."""
    draw = random.Random(12)
    lines = [[f"l{n}x{i}" for i in range(20)] for n in range(6)]
    rows = [(i, sum(draw.choices(lines, k=8), [])) for i in range(60)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    covered = {}
    for r in passages.repeated_passages(table).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    places = {}
    for i, words in rows:
        for at in range(len(words) - 49):
            places.setdefault(tuple(words[at : at + 50]), set()).add((i, at))
    repeated = {p for group in places.values() if len({i for i, _ in group}) > 1 for p in group}
    missed = [(i, at) for i, at in repeated if not covered.get(i, set()) >= set(range(at, at + 50))]
    assert repeated and not missed


def test_passage_that_stands_often():
    """9 times in one text and 30 times in the other: every place has a passage of its own or lies in a longer one."""
    draw = random.Random(13)

    def prose(n):
        return [f"o{draw.randrange(10**6)}" for _ in range(n)]

    passage = prose(60)
    a, b = (sum((prose(100) + passage for _ in range(n)), []) for n in (9, 30))
    wa, wb = (word_hashes(" ".join(w)).astype("<u4") for w in (a, b))
    got = passages.passages(wa, wb)
    for n, side in ((9, 0), (30, 2)):
        assert all(any(p[side] <= 160 * x + 100 and p[side + 1] >= 160 * x + 160 for p in got) for x in range(n))


def test_passage_of_lines_in_other_orders():
    """Lines repeat in other numbers and orders around a passage made of them."""
    for seed in range(20):
        draw = random.Random(seed)
        lines = [[f"k{n}x{i}" for i in range(9)] for n in range(5)]
        common = sum(draw.choices(lines, k=8), [])
        a, b = (sum(draw.choices(lines, k=60), []) + common + sum(draw.choices(lines, k=50), []) for _ in range(2))
        wa, wb = (word_hashes(" ".join(w)).astype("<u4") for w in (a, b))
        covered = [set(), set()]
        for start, end, other, other_end, _ in passages.passages(wa, wb):
            covered[0].update(range(start, end))
            covered[1].update(range(other, other_end))
        runs = [{tuple(w[i : i + 50]) for i in range(len(w) - 49)} for w in (a, b)]
        for own, w in zip(covered, (a, b)):
            for i in range(len(w) - 49):
                if tuple(w[i : i + 50]) in runs[0] & runs[1]:
                    assert own >= set(range(i, i + 50))


def test_cover():
    draw = random.Random(14)
    for _ in range(300):
        starts = sorted(draw.sample(range(60), draw.randrange(1, 12)))
        ends = []
        for s in starts:
            ends.append(max([s + 1, *(e + 1 for e in ends[-1:])]) + draw.randrange(12))
        chosen = passages._cover(starts, ends)
        assert set().union(*(range(starts[n], ends[n]) for n in chosen)) == set().union(*map(range, starts, ends))
        assert chosen == sorted(set(chosen))
