import random
from collections import Counter

from pyspark.sql import functions as F

from textloom.operators import characters as C


def expected(rows):
    counts, first = Counter(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for at, ch in enumerate(text or ""):
            counts[ch] += 1
            first.setdefault(ch, (key, at))
    return {ch: (n, *first[ch]) for ch, n in counts.items()}


def result(frame):
    return {r["ch"]: (r["n"], *r["first_at"]) for r in frame.collect()}


def test_summary_of_random_texts(spark, monkeypatch):
    rng = random.Random(3)
    alphabet = "ab  \n\x00éß日本😀\U0010ffff￿"
    rows = [(rng.choice([None, *range(40)]) if i < 3 else 100 + i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 90])))) for i in range(300)]
    rows = [*dict(rows).items(), (7000, None), (7001, "")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, unit string")
    assert result(C.character_summary(frame.repartition(5))) == expected(rows)
    held = {}
    for i in range(0, len(rows), 7):  # any split of the rows gives the same
        C.merge_slice(held, [k for k, _ in rows[i : i + 7]], [t or "" for _, t in rows[i : i + 7]])
    assert {chr(c): (v[0], v[2], v[1][1]) for c, v in held.items()} == expected(rows)


def test_summary_equals_one_row_per_character(spark, docs):
    plain = docs.select("doc_id", F.posexplode(F.split("text", "")).alias("at", "ch")).where("ch <> ''")
    plain = plain.groupBy("ch").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("first_at"))
    assert result(C.character_summary(docs.withColumnRenamed("text", "unit"))) == result(plain)


def test_summary_of_text_keys_and_empty_tables(spark):
    frame = spark.createDataFrame([("b", "xy"), ("a", "y"), (None, "z")], "k string, t string")
    assert result(C.character_summary(frame, "k", "t")) == {"x": (1, "b", 0), "y": (2, "a", 0), "z": (1, None, 0)}
    assert C.character_summary(frame.limit(0), "k", "t").collect() == []
    assert C.character_totals(frame, "t").where("ch = 'y'").first()["n"] == 2
