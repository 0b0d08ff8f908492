"""Personal data: base kinds against Python's regular expressions, added spans on planted variants."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import pii as P

SCHEMA = "doc_id bigint, text string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    number = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(number))]
        return 13 <= len(number) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(number) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def check(rows, result):
    """Every row has its base spans, in order; returns the added ones by row."""
    got = result.collect()
    assert len(got) == len(rows)
    texts, out = {}, []
    for key, text in rows:
        texts.setdefault(key, []).append(text)
    for r in got:
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s]
        base = [s for s in spans if s[0] in PATTERNS]
        match = [t for t in texts[r["doc_id"]] if base_spans(t) == base]
        assert match, (r, [base_spans(t) for t in texts[r["doc_id"]]])
        texts[r["doc_id"]].remove(match[0])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        order = [*PATTERNS, *(f"{k}_like" for k in PATTERNS)]
        assert spans == sorted(spans, key=lambda s: (order.index(s[0]), s[1]))
        out += [(r["doc_id"], match[0][a:b], k) for k, a, b in spans if k not in PATTERNS]
    return out


def test_random_texts(spark):
    rng = random.Random(4)
    pieces = ["0", "1", "25", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+1", "+", "-", " ", ".", "..", "(", ")", "@", "a", "b.c", "_", "%", "é", "\U0001f600",
              "x@y.z", "1.2.3.4", "\n", "+1 (614) 555-8001", "at", " at ", " dot ", "\t", "00", "5500005555555559"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(4000)]
    check(rows, P.personal_data(spark.createDataFrame(rows, SCHEMA)))


def test_query_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert any(base_spans(t) for _, t in rows)
    check(rows, P.personal_data(table))


def test_odd_rows(spark):
    long = "9" * 2000 + " " + "a" * 2000 + "@" + "b." * 3000 + "c " + "1." * 4000 + "1 +" + "1 " * 3000 + "z " * 90_000 + "me@here.org"
    rows = [(1, "me@here.org"), (1, "me@here.org"), (2, None), (3, ""), (None, "call +1 (614) 555-8001"), (None, "call +1 (614) 555-8001"), (4, long),
            (5, "me@here.org"), (1, "another version, 10.0.0.1")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert check(rows, P.personal_data(frame)) == []
    clashing = frame.withColumns({c: F.lit("x") for c in ("blob", "found", "family", "label", "features", "score", "start", "end", "m", "kind", "held", "probability")})
    check(rows, P.personal_data(clashing))
    assert P.personal_data(frame.limit(0)).collect() == []


def test_long_runs_take_their_length(spark):
    """Runs of a megabyte, which plain repeats would take hours for."""
    text = "9" * 1_000_000 + " " + "a" * 1_000_000 + "@" + "b." * 500_000 + "c"
    r = P.personal_data(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert r["spans"] == f"email:1000001:{len(text)}" and r["n_email"] == 1 and r["n_card"] == 0


def luhn(rng, ok):
    while True:
        number = "".join(rng.choice("0123456789") for _ in range(16))
        if passes("card", number) == ok:
            return number


@pytest.fixture(scope="module")
def planted():
    """Rows with known data, numbers that are none, and (in every ninth row) data in other dress."""
    rng = random.Random(7)
    words = [w * 2 for w in "oak elm ash fir yew box bay fig".split()]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, dressed = [], {}
    for key in range(1800):
        name, host = rng.choice(words), rng.choice(words)
        phone = f"({rng.randint(200, 999)}) 555-{number(4)}"
        known = rng.choice([f"mail {name}.{host}@{host}.com", f"call +1 {phone}", f"card {luhn(rng, True)}", f"host 10.{rng.randint(0, 255)}.3.{rng.randint(0, 255)}"])
        none = rng.choice([f"order {luhn(rng, False)}", f"version {rng.randint(1, 9)}.{rng.randint(300, 999)}.{rng.randint(1, 9)}.{rng.randint(300, 999)}", f"page {number(3)}"])
        text = f"{prose(9)} {known}, {prose(6)} {none}. {prose(4)}"
        if key % 9 == 0:
            other = rng.choice([f"{name}.{host}[at]{host}.com", f"{phone}"])
            dressed[key] = other
            text += f" {'mail' if 'at' in other else 'call'} {other}, {prose(3)}"
        rows.append((key, text))
    return rows, dressed


def test_added_spans(spark, planted):
    rows, dressed = planted
    added = check(rows, P.personal_data(spark.createDataFrame(rows, SCHEMA)))
    right = {(k, v) for k, v, _ in added if k in dressed and (v in dressed[k] or dressed[k] in v)}
    assert len(right) >= 0.6 * len(dressed)
    assert len(right) >= 0.97 * len(added)  # and hardly anything else


def test_no_negatives_adds_nothing(spark):
    rows = [(i, f"mail a{i}@b.com") for i in range(50)]
    assert check(rows, P.personal_data(spark.createDataFrame(rows, SCHEMA))) == []
