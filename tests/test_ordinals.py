import random

from pyspark.sql import functions as F

from textloom.operators import ordinals as O


def test_running_totals_over_many_buckets(spark):
    rng = random.Random(2)
    # Clustered keys: a third in a narrow range, one far outlier.
    keys = sorted(set([rng.randrange(50) + 10**9 for _ in range(400)] + [rng.randrange(10**6) for _ in range(600)] + [10**15]))
    rows = [(k, rng.randrange(10)) for k in keys]
    df = spark.createDataFrame(rows, "k bigint, v bigint")
    got = O.running_totals(df, "k", rows_per_bucket=16, before=F.col("v"), ordinal=F.lit(1).cast("bigint")).orderBy("k").collect()
    total = 0
    for i, (r, (k, v)) in enumerate(zip(got, rows)):
        assert (r["k"], r["ordinal"], r["before"]) == (k, i, total)
        total += v


def test_text_keys_and_groups(spark):
    df = spark.createDataFrame([(g, f"p{i:03d}", i) for g in "ab" for i in range(40)], "g string, k string, v bigint")
    got = O.running_totals(df, "k", rows_per_bucket=8, by=["g"], before=F.col("v")).collect()
    assert all(r["before"] == sum(range(r["v"])) for r in got)


def test_values_at(spark):
    values = [5, 1, 1, 9, 3, 7]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    row = O.values_at(df, "v", upper=lambda n: F.floor(n / 2), last=lambda n: n - 1).first()
    assert (row["upper"], row["last"], row["count"]) == (sorted(values)[3], 9, 6)


def test_budget_keeps_the_crossing_document(spark):
    df = spark.createDataFrame([(i, "é" * 5) for i in range(10)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in O.take_until_budget(df, "doc_id", "text", 25).orderBy("doc_id").collect()] == [0, 1, 2]
    assert O.take_until_budget(df, "doc_id", "text", 1000, max_docs=4).count() == 4


def test_held_out_head(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    assert O.head_by_order(df, "k", 0.1).where("held_out").count() == 2
