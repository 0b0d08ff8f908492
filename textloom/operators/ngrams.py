"""Character n-gram models: count tables, backoff scoring, reference floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADD_K = 0.05  # fixed value: smoothing added to every count


def ngram_table(grams: DataFrame) -> DataFrame:
    """(order, context, ch, n) for all orders, as suffix sums of the maximal grams."""
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda m: F.right(F.col("gram"), m)))
    return (
        grams.select(suffix.alias("gram"), "n")
        .groupBy("gram").agg(F.sum("n").alias("n"))
        .select(
            F.length("gram").alias("order"),
            F.left("gram", F.length("gram") - 1).alias("context"),
            F.right("gram", F.lit(1)).alias("ch"),
            "n",
        )
    )


def context_totals(table: DataFrame) -> DataFrame:
    return table.groupBy("order", "context").agg(F.sum("n").alias("total"))


def backoff_probabilities(grams: DataFrame, table: DataFrame, vocab_size: Column, add_k: float = ADD_K) -> DataFrame:
    """Probability of the last character of each distinct gram.

    The highest order whose context was seen decides; scoring distinct grams
    weighted by their count replaces one join row per stream position.  Only
    contexts of a character or more are joined: the empty one is a single
    total, not a key that every gram would meet.
    """
    longer = table.where(F.col("order") >= 2)
    tried = grams.where(F.length("gram") >= 2).select("gram", F.explode(F.sequence(F.lit(2), F.length("gram"))).alias("order")).select(
        "gram", "order", F.left(F.right(F.col("gram"), F.col("order")), F.col("order") - 1).alias("context"),
    )
    chosen = (
        tried.join(context_totals(longer), ["order", "context"])
        .groupBy("gram").agg(F.max(F.struct("order", "context", "total")).alias("best"))
        .select("gram", "best.*")
    )
    plain = table.where(F.col("order") == 1)
    seen = chosen.withColumn("ch", F.right("gram", F.lit(1))).join(longer, ["order", "context", "ch"], "left").select(
        "gram", "total", F.coalesce("n", F.lit(0)).alias("hits")
    )
    alone = plain.select("ch", F.col("n").alias("ch_n"))
    scored = grams.join(seen, "gram", "left").withColumn("ch", F.right("gram", F.lit(1))).join(F.broadcast(alone), "ch", "left")
    total = F.coalesce(F.col("total"), plain.agg(F.sum("n")).scalar())
    hits = F.when(F.col("total").isNotNull(), F.col("hits")).otherwise(F.coalesce("ch_n", F.lit(0)))
    p = (hits + add_k) / (total + add_k * vocab_size)
    return scored.select("gram", "n", F.coalesce(p, 1.0 / vocab_size).alias("p"))


def bits_per_character(scored: DataFrame) -> DataFrame:
    bits = F.sum(-F.log2("p") * F.col("n")) / F.sum("n")
    return scored.agg(F.sum("n").alias("positions"), bits.alias("bpc"))
