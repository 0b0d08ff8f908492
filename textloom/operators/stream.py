"""The corpus as one ordered character stream, kept as a distributed table.

Documents are joined by a blank line.  Every document but the first owns the
separator in front of it ("unit"), so the stream is the concatenation of the
units in key order and no document ever has to meet another one to be counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.coding import window_counts
from textloom.operators.ordinals import running_totals

SEPARATOR = "\n\n"
SPLITS = ("train", "val", "test")


def units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    first = docs.agg(F.min(key)).scalar()
    joined = F.when(F.col(key) == first, F.col(text)).otherwise(F.concat(F.lit(SEPARATOR), F.col(text)))
    return docs.select(key, joined.alias("unit"))


def placed_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Units with ordinal and global start position in the stream."""
    sized = units(docs, key, text).withColumn("n", F.length("unit").cast("bigint"))
    return running_totals(sized, key, start=F.col("n"), ordinal=F.lit(1).cast("bigint"))


def split_sizes(total: Column, val_frac: float = 0.1, test_frac: float = 0.1) -> dict[str, tuple[Column, Column]]:
    """[from, to) of each split: validation and test are at least one token, test is last."""
    n_test = F.greatest(F.lit(1), F.floor(total * F.lit(test_frac)))
    n_val = F.greatest(F.lit(1), F.floor(total * F.lit(val_frac)))
    zero = F.lit(0).cast("bigint")
    return {
        "train": (zero, total - n_val - n_test),
        "val": (total - n_val - n_test, total - n_test),
        "test": (total - n_test, total),
    }


def split_ranges(placed: DataFrame, val_frac: float = 0.1, test_frac: float = 0.1) -> DataFrame:
    """One row per (unit, split) overlap; a unit on a border appears in both splits."""
    total = placed.agg(F.sum("n")).scalar()
    end = F.col("start") + F.col("n")
    sized = placed.withColumn("total", total)
    parts = [
        F.struct(F.lit(name).alias("split"), F.greatest(F.col("start"), lo).alias("lo"), F.least(end, hi).alias("hi"))
        for name, (lo, hi) in split_sizes(F.col("total"), val_frac, test_frac).items()
    ]
    overlap = F.filter(F.array(*parts), lambda p: p["lo"] < p["hi"])
    return sized.select("*", F.explode(overlap).alias("part")).select(
        *[c for c in sized.columns if c != "total"], "part.*"
    )


def split_pieces(placed: DataFrame, val_frac: float = 0.1, test_frac: float = 0.1) -> DataFrame:
    """Text of every unit cut at the split borders."""
    whole = (F.col("lo") == F.col("start")) & (F.col("hi") == F.col("start") + F.col("n"))
    cut = F.substr(F.col("unit"), (F.col("lo") - F.col("start") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    ranges = split_ranges(placed, val_frac, test_frac)
    return ranges.withColumn("piece", F.when(whole, F.col("unit")).otherwise(cut)).drop("unit")


def placed_tokens(rows: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """Rows of token ids, of either tokenizer, with their start in the token stream."""
    sized = rows.select(key, F.col(ids).alias("ids"), F.size(ids).cast("bigint").alias("n"))
    return running_totals(sized, key, start=F.col("n"))


def token_splits(placed: DataFrame, val_frac: float = 0.1, test_frac: float = 0.1) -> DataFrame:
    """Ids of every row cut at the split borders; ``at`` counts from the start of the split."""
    ranges = split_ranges(placed, val_frac, test_frac)
    first = ranges.groupBy("split").agg(F.min("lo").alias("base"))  # three rows
    cut = F.slice("ids", (F.col("lo") - F.col("start") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    return ranges.withColumn("ids", cut).join(F.broadcast(first), "split").withColumn("at", F.col("lo") - F.col("base")).drop("base", "start", "n")


def token_blocks(pieces: DataFrame, block: int, by: Sequence[str] = ("split",), at: str = "at") -> DataFrame:
    """Consecutive blocks of ``block`` ids per group, each gathered from the rows that overlap it."""
    end = F.col(at) + F.size("ids")
    numbers = F.sequence(F.floor(F.col(at) / block), F.floor((end - 1) / block))

    def part(b: Column) -> Column:
        start = F.greatest(F.col(at), b * block)
        ids = F.slice("ids", (start - F.col(at) + 1).cast("int"), (F.least(end, (b + 1) * block) - start).cast("int"))
        return F.struct(b.alias("block_id"), start.alias("start"), ids.alias("ids"))

    parts = pieces.where(F.size("ids") > 0).select(*by, F.inline(F.transform(numbers, part)))
    ordered = F.array_sort(F.collect_list(F.struct("start", "ids")))
    return parts.groupBy(*by, "block_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def token_windows(blocks: DataFrame, starts: DataFrame, block: int) -> DataFrame:
    """x = ids [s, s+B) and y shifted by one; every window lies in two neighbouring blocks."""
    wanted = starts.select("sample_id", "start", F.explode(F.array(F.floor(F.col("start") / block), F.floor(F.col("start") / block) + 1)).alias("block_id"))
    ordered = F.array_sort(F.collect_list(F.struct("block_id", "ids")))
    joined = wanted.join(blocks, "block_id").groupBy("sample_id", "start").agg(F.flatten(F.transform(ordered, lambda b: b["ids"])).alias("pair"))
    first = (F.pmod(F.col("start"), F.lit(block)) + 1).cast("int")
    return joined.select("sample_id", "start", F.slice("pair", first, F.lit(block)).alias("x"), F.slice("pair", first + 1, F.lit(block)).alias("y"))


def maximal_grams(pieces: DataFrame, order: int, by: str | None = "split") -> DataFrame:
    """Counts of the longest gram (at most ``order`` characters) ending at each position.

    Every lower order is a suffix sum of this table.  Positions deep inside a
    piece come from its own text; the first ``order - 1`` positions also need
    the end of the pieces before, which travel as short strings keyed by
    ordinal.  Pieces after the first of a split hold at least the separator, so
    looking back ``ceil((order - 1) / 2)`` pieces is enough.
    """
    group = [by] if by else []
    k = order - 1
    counted = window_counts(pieces, "piece", order, group)
    if k == 0:
        return counted
    rim = pieces.select(*group, "ordinal", F.left("piece", F.lit(k)).alias("head"), F.right("piece", F.lit(k)).alias("tail"))
    looked = rim
    for back in range(1, -(-k // len(SEPARATOR)) + 1):
        before = rim.select(*group, (F.col("ordinal") + back).alias("ordinal"), F.col("tail").alias(f"tail_{back}"))
        looked = looked.join(before, [*group, "ordinal"], "left")
    tails = [F.coalesce(F.col(f"tail_{b}"), F.lit("")) for b in range(-(-k // len(SEPARATOR)), 0, -1)]
    context = F.right(F.concat(*tails), F.lit(k))
    rims = looked.select(*group, "head", context.alias("context")).select(
        *group,
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("head")),
                lambda j: F.right(F.concat(F.col("context"), F.left(F.col("head"), j)), F.lit(order)),
            )
        ).alias("gram"),
    ).where(F.length("gram") > 0)
    return (
        counted.unionByName(rims.groupBy(*group, "gram").agg(F.count("*").alias("n")))
        .groupBy(*group, "gram").agg(F.sum("n").alias("n"))
    )
