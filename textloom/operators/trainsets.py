"""Instruction and preference sets built from a document table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ordinals import with_ordinal
from textloom.session import materialize


@dataclass(frozen=True)
class DefinitionRule:
    """How a defining sentence looks and how question and answer are worded.

    Fixed values: the default sentence pattern, title hygiene and wording.
    """

    pattern: str = r"^(.{1,14}?)是(.{8,80}?。)"
    bad_title: str = r"[，。、；：（）「」『』\s0-9A-Za-z]"
    question: str = "什麼是%s？"
    statement: str = "%s是%s"
    stop: str = "。"


SFT_RULE = DefinitionRule()
PREFERENCE_RULE = DefinitionRule(pattern=r"^(.{1,14}?)是(.{8,60}?。)")
PROMPT_TEMPLATE = "問：%s\n答："    # fixed value: prompt wording shared by all sets
RESPONSE_SUFFIX = "\n\n"            # fixed value: end of an answer
STRIDE = 337                        # fixed value: distance to the borrowed body
HELD_OUT_SHARE = 0.1


def definitions(docs: DataFrame, rule: DefinitionRule = SFT_RULE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Title and body of texts that open with a defining sentence."""
    pattern = "(?d)" + rule.pattern
    return docs.where(F.col(text).rlike(pattern)).select(
        key, F.regexp_extract(text, pattern, 1).alias("title"), F.regexp_extract(text, pattern, 2).alias("body")
    )


def clean_titles(items: DataFrame, rule: DefinitionRule = SFT_RULE, key: str = "doc_id", limit: int | None = None) -> DataFrame:
    """Clean titles only, first document per title; with ``limit``, the first so many in order."""
    good = items.where(~F.col("title").rlike("(?U)" + rule.bad_title))
    first = good.groupBy("title").agg(F.min(key).alias(key))
    kept = good.join(first, ["title", key], "left_semi").select(key, "title", "body")
    return kept.orderBy(key).limit(limit) if limit is not None else kept


def instruction_pairs(items: DataFrame, rule: DefinitionRule = SFT_RULE, key: str = "doc_id") -> DataFrame:
    return items.select(
        key, F.format_string(rule.question, "title").alias("q"), F.format_string(rule.statement, "title", "body").alias("a")
    )


def chat_text(q: Column, a: Column) -> Column:
    return F.concat(F.format_string(PROMPT_TEMPLATE, q), a, F.lit(RESPONSE_SUFFIX))


def held_out_split(rows: DataFrame, key: str, share: float = HELD_OUT_SHARE) -> DataFrame:
    """The first int(n * share) rows in order are held out."""
    n = rows.agg(F.count("*")).scalar()
    return with_ordinal(rows, key).withColumn("held_out", F.col("ordinal") < F.floor(n * F.lit(share)))


def off_topic_pairs(items: DataFrame, rule: DefinitionRule = PREFERENCE_RULE, key: str = "doc_id", stride: int = STRIDE) -> DataFrame:
    """Rejected answer borrows the body of the item ``stride`` places further on."""
    placed = with_ordinal(items, key)
    n = items.agg(F.count("*")).scalar()
    wanted = placed.select(key, "ordinal", "title", "body", F.pmod(F.col("ordinal") + stride, n).alias("donor"))
    donors = placed.select(F.col("ordinal").alias("donor"), F.col("title").alias("other_title"), F.col("body").alias("other_body"))
    return wanted.join(donors, "donor").where(
        (F.col("title") != F.col("other_title")) & (F.col("body") != F.col("other_body"))
    ).select(
        key, "ordinal",
        F.format_string(rule.question, "title").alias("prompt"),
        F.format_string(rule.statement, "title", "body").alias("chosen"),
        F.format_string(rule.statement, "title", "other_body").alias("rejected"),
    )


def looped_body(body: Column, stop: str = PREFERENCE_RULE.stop) -> Column:
    """First two characters repeated to about the same length."""
    seed = F.substring(body, 1, 2)
    times = F.greatest(F.lit(1), F.floor((F.length(body) - 1) / F.length(seed))).cast("int")
    return F.concat(F.repeat(seed, times), F.lit(stop))


def degenerate_pairs(items: DataFrame, rule: DefinitionRule = PREFERENCE_RULE, key: str = "doc_id") -> DataFrame:
    return items.select(
        key,
        F.format_string(rule.question, "title").alias("prompt"),
        F.format_string(rule.statement, "title", "body").alias("chosen"),
        F.format_string(rule.statement, F.col("title"), looped_body(F.col("body"), rule.stop)).alias("rejected"),
    )


def masked_example(prompt_ids: Column, response_ids: Column, block_size: int) -> Column:
    """Token ids of prompt and response with a 0/1 response mask, cut to the block."""
    ids = F.slice(F.concat(prompt_ids, response_ids), 1, block_size)
    mask = F.slice(
        F.concat(F.array_repeat(F.lit(0), F.size(prompt_ids)), F.array_repeat(F.lit(1), F.size(response_ids))), 1, block_size
    )
    return F.struct(ids.alias("ids"), mask.alias("mask"))


def padded_batches(examples: DataFrame, batch: str, order: str, ids: str = "ids", mask: str = "mask") -> DataFrame:
    """Right-pad ids and mask to the longest sequence of each batch.

    The longest length comes from an aggregate joined back, so a batch column
    with a hot value is not pulled into one task.
    """
    longest = examples.groupBy(batch).agg(F.max(F.size(ids)).alias("width"))
    joined = examples.join(longest, batch)
    pad = F.array_repeat(F.lit(0), F.col("width") - F.size(ids))
    return joined.select(
        batch, order, F.concat(ids, pad).alias("ids"), F.concat(mask, pad).alias("mask"),
        (F.size(ids) - 1).alias("last_idx"), "width",
    )


def interleaved(pairs: DataFrame, key: str, batch_size: int) -> DataFrame:
    """Chosen on even rows, rejected on odd rows, ``batch_size`` pairs per batch."""
    batch = F.floor(F.col("ordinal") / batch_size)
    sides = F.inline(F.array(
        F.struct(F.lit("chosen").alias("side"), (F.col("ordinal") * 2).alias("row"), F.col("chosen").alias("response")),
        F.struct(F.lit("rejected").alias("side"), (F.col("ordinal") * 2 + 1).alias("row"), F.col("rejected").alias("response")),
    ))
    return pairs.select(key, "prompt", batch.alias("batch"), sides)


def hash_unit(*parts: Column) -> Column:
    """Reproducible number in [0, 1) from a SHA-1 of the parts."""
    digest = F.sha1(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def scrambled(text: Column, seed: int = 7) -> Column:
    """Same characters in random order: the control negative."""
    return F.array_join(F.shuffle(F.split(text, ""), F.lit(seed)), "")


def control_axes(segments: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """Learnable axis (real against scrambled) and noise axis (coin-flip labels).

    The noise axis pairs every segment with the next one; the first half of
    the order is for training, the second half is held out.
    """
    n = segments.agg(F.count("*")).scalar()
    ordinals = materialize(with_ordinal(materialize(segments.select(key), "keys"), key), "ordinals")
    placed = segments.select(key, text).join(ordinals, key).withColumn("n", n)
    train = F.col("ordinal") < F.floor(F.col("n") / 2)
    real = placed.select(
        key, F.lit("learnable").alias("axis"), train.alias("train"), F.col(text).alias("chosen"), scrambled(F.col(text), seed).alias("rejected")
    )
    other = placed.select(F.col("ordinal").alias("mate"), F.col(text).alias("other"))
    paired = placed.withColumn("mate", F.pmod(F.col("ordinal") + 1, F.col("n"))).join(other, "mate")
    heads = hash_unit(F.lit(seed), F.col(key)) < 0.5
    noise = paired.select(
        key, F.lit("noise").alias("axis"), train.alias("train"),
        F.when(heads, F.col(text)).otherwise(F.col("other")).alias("chosen"),
        F.when(heads, F.col("other")).otherwise(F.col(text)).alias("rejected"),
    )
    return real.unionByName(noise)
