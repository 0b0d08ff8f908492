"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import variants as V

SCHEMA = "doc_id bigint, text string"


def count_words(rows):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def by_hand(words):
    out, form = {}, {}
    for w, n in words.items():
        others = sorted((-words[x], x) for x in words if near(w, x))
        best = others[0] if others and -others[0][0] >= 2 * n else None
        form[w] = best[1] if best else None
        out[w] = [form[w], None, n, len(others), -best[0] if best else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return sorted((w, *map(str, v)) for w, v in out.items())


def result(frame):
    return sorted((r["word"], *map(str, (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]))) for r in frame.collect())


def invented(seed, letters, sizes, n):
    """Texts of words that are often a letter or two away from each other."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(60)]
    rows = []
    for key in range(n):
        text = []
        for _ in range(120):
            word = list(rng.choice(base[: rng.choice([5, 20, 60])]))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(word))
                word[at : at + rng.randrange(2)] = [rng.choice(letters)] * rng.randrange(3)
            text.append("".join(word))
        rows.append((key, rng.choice([" ", ", ", "1", "日", "—"]).join(text)))
    return rows


@pytest.mark.parametrize("shard_words, visitors", [(20_000, 50_000), (40, 30), (1, 7)])
@pytest.mark.parametrize("letters, sizes", [("abcdefgh", [5, 6, 7]), ("am", [7, 8]), ("éÀaÿ×zZ", [5, 9]), ("ab", [40, 41])])
def test_against_all_pairs(spark, shard_words, visitors, letters, sizes):
    rows = invented(5, letters, sizes, 25)
    expected = by_hand(count_words(rows))
    assert len(expected) > 20 and any(e[2] != e[0] for e in expected)
    assert result(V.spelling_variants(spark.createDataFrame(rows, SCHEMA), shard_words=shard_words, visitors=visitors)) == expected


def test_query_words(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = count_words([(r["doc_id"], r["text"]) for r in table.collect()])
    counted = {r["word"]: r["n"] for r in V.words(table).collect()}
    assert counted == words
    # all near words by deleting each letter: two words are near if they meet in a deletion at one place, or one is the other's deletion
    holes, expected = {}, Counter()
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), []).append(w)
    pairs = {(a, b) for group in holes.values() for a in group for b in group if a != b}
    pairs |= {p for w in words for i in range(len(w)) if (s := w[:i] + w[i + 1 :]) in words for p in ((w, s), (s, w))}
    for a, _ in pairs:
        expected[a] += 1
    got = {r["word"]: r["n_near"] for r in V.spelling_variants(table, shard_words=300, visitors=500).collect()}
    assert got == {w: expected[w] for w in words}


def test_runs():
    text = "Über naïve—word日本語ABC ×÷ d'été \x00x\U0001f600y ß"
    expected = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert [w.decode() for w in V.runs(text.encode())] == expected


def test_one_edit_of_all_lengths():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in (5, 6, 31, 32, 33, 34) for _ in range(40)]
    items = [w.encode() for w in words]
    pairs = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(a) in (len(b), len(b) + 1)]
    pairs += [(i, i) for i in range(len(words))]
    ok = V.Verifier(items, items).near(*np.array(pairs).T)
    assert [bool(x) for x in ok] == [near(words[i], words[j]) for i, j in pairs]


def test_odd_rows(spark):
    rows = [(1, "quite quiet quite"), (1, "quite quiet quite"), (2, None), (3, ""), (None, "quite Quite QUITE quiet"), (None, "quite Quite QUITE quiet"),
            (4, "x" * 70_000 + " " + "x" * 70_001), (5, "tiesa tiesb tiesc " * 3), (6, " ".join(f"w{'o' * (i % 7)}rd" for i in range(50_000)))]
    rows += [(7, "x" * 70_000 + " " + "x" * 70_001)] * 2
    frame = spark.createDataFrame(rows, SCHEMA)
    words = count_words(rows)
    expected = by_hand({w: n for w, n in words.items()})
    assert result(V.spelling_variants(frame)) == expected
    clashing = frame.withColumns({c: F.lit("x") for c in ("word", "n", "form", "root", "key", "bucket", "cell", "home", "best", "further")})
    assert result(V.spelling_variants(clashing)) == expected
    assert V.spelling_variants(frame.limit(0)).collect() == []
    assert V.spelling_variants(frame.where("text IS NULL")).collect() == []
