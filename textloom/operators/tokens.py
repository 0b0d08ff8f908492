"""Character vocabulary, coding, splits, packing and training windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.coding import decode_column, encode_column
from textloom.operators.stream import maximal_grams, units

UINT16_MAX = 65535  # fixed value: ids above this need the wide type


def char_vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """Sorted distinct characters with ids from 0 (at most one row per code point)."""
    chars = texts.select(F.explode(F.split(F.col(text), "")).alias("token")).where(F.col("token") != "").distinct()
    rank = F.row_number().over(Window.orderBy("token")) - 1
    return chars.select(rank.cast("bigint").alias("token_id"), "token")


def stream_vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return char_vocabulary(units(docs, key, text), "unit")


def vocabulary_tokens(vocab: DataFrame) -> list[str]:
    """Tokens by id on the driver; a vocabulary is bounded by Unicode plus the merges."""
    return [r["token"] for r in vocab.orderBy("token_id").select("token").collect()]


def encode_chars(texts: DataFrame, vocab: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
    """Token ids per row; an unknown character is an error."""
    return texts.withColumn(ids, encode_column(vocabulary_tokens(vocab))(F.col(text)))


def decode_tokens(table: DataFrame, vocab: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
    return table.withColumn(text, decode_column(vocabulary_tokens(vocab))(F.col(ids)))


def token_dtype(vocab_size: Column) -> Column:
    return F.when(vocab_size > UINT16_MAX, F.lit("uint32")).otherwise(F.lit("uint16"))


def pair_counts(pieces: DataFrame) -> DataFrame:
    """Adjacent, overlapping character pairs of the stream."""
    grams = maximal_grams(pieces, 2, by=None).where(F.length("gram") == 2)
    return grams.select(F.left("gram", F.lit(1)).alias("left"), F.right("gram", F.lit(1)).alias("right"), "n")


def token_pair_counts(table: DataFrame, ids: str = "ids") -> DataFrame:
    """Adjacent pairs inside each row's token array."""
    pairs = F.arrays_zip(
        F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))).alias("l"), F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))).alias("r")
    )
    return table.select(F.inline(pairs)).toDF("left_id", "right_id").groupBy("left_id", "right_id").agg(F.count("*").alias("n"))


def block_pieces(placed: DataFrame, block: int, text: str = "unit") -> DataFrame:
    """Cut placed text at multiples of ``block`` stream positions, linear in its length."""
    head = (F.lit(block) - F.pmod(F.col("start"), F.lit(block))).cast("int")
    first = F.left(F.col(text), head)
    rest = F.regexp_extract_all(F.substr(F.col(text), head + 1), F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    cut = F.filter(F.concat(F.array(first), rest), lambda p: F.length(p) > 0)
    pieces = placed.select("start", F.posexplode(cut).alias("at", "piece"))
    block_id = F.floor(F.col("start") / block) + F.col("at")
    return pieces.select(block_id.alias("block_id"), F.greatest(F.col("start"), block_id * block).alias("pos"), "piece")


def stream_blocks(placed: DataFrame, block: int, text: str = "unit") -> DataFrame:
    """The stream as consecutive blocks of ``block`` characters (a bounded group each)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return block_pieces(placed, block, text).groupBy("block_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("tokens")
    )


def window_starts(spark, total: Column, n: int, block: int, seed: str = "windows") -> DataFrame:
    """``n`` reproducible starts in [0, total - block), from a hash of the sample number."""
    draw = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("bigint")
    return spark.range(n).select(F.col("id").alias("sample_id"), F.pmod(draw, total - block).alias("start"))


def training_windows(blocks: DataFrame, starts: DataFrame, block: int) -> DataFrame:
    """x = [s, s+B) and y shifted by one; every window lies in two neighbouring blocks."""
    wanted = starts.select(
        "sample_id", "start", F.explode(F.array(F.floor(F.col("start") / block), F.floor(F.col("start") / block) + 1)).alias("block_id")
    )
    ordered = F.array_sort(F.collect_list(F.struct("block_id", "tokens")))
    joined = wanted.join(blocks, "block_id").groupBy("sample_id", "start").agg(
        F.array_join(F.transform(ordered, lambda b: b["tokens"]), "").alias("pair")
    )
    at = (F.pmod(F.col("start"), F.lit(block)) + 1).cast("int")
    return joined.select(
        "sample_id", "start", F.substr("pair", at, F.lit(block)).alias("x"), F.substr("pair", at + 1, F.lit(block)).alias("y")
    )


def round_trip(pieces: DataFrame, vocab: DataFrame) -> DataFrame:
    """Decode the encoded pieces and compare them with the text, by hash, per split."""
    tokens = vocabulary_tokens(vocab)
    coded = pieces.select("split", "piece", encode_column(tokens)(F.col("piece")).alias("ids"))
    back = coded.select("split", "piece", F.size("ids").alias("n"), decode_column(tokens)(F.col("ids")).alias("decoded"))
    return back.groupBy("split").agg(
        F.count("*").alias("pieces"), F.sum("n").alias("tokens"),
        F.bool_and(F.sha1("piece") == F.sha1("decoded")).alias("lossless"),
    )


def coverage(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Characters, unknown characters and coverage of a counted text against a vocabulary."""
    total = counts.agg(F.sum("n").alias("chars"))
    unknown = counts.join(vocab, counts["ch"] == vocab["token"], "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("oov_chars"), F.count("*").alias("oov_symbols")
    )
    return total.select(
        "chars", unknown.select("oov_chars").scalar().alias("oov_chars"), unknown.select("oov_symbols").scalar().alias("oov_symbols")
    ).withColumn("coverage", F.when(F.col("chars") > 0, 1 - F.col("oov_chars") / F.col("chars")).otherwise(1.0))
