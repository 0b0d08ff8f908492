"""Metrics over score tables: per-token and per-sequence scores of any model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAME_BAND = 0.02       # fixed value: loss differences inside it count as equal
ENSEMBLE_FLOOR = 1e-9  # fixed value: keeps the ensemble logarithm finite
SPREAD_FLOOR = 1e-6    # fixed value: keeps standardised rewards finite


# ---- losses and comparisons ------------------------------------------------

def split_losses(tokens: DataFrame, by: Sequence[str] = ("split",), loss: str = "loss", weight: str | None = None) -> DataFrame:
    """Mean loss (4 decimals) and perplexity (2 decimals) per split."""
    mean = F.avg(loss) if weight is None else F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)
    return tokens.groupBy(*by).agg(mean.alias("mean")).select(
        *by, F.round("mean", 4).alias("loss"), F.round(F.exp("mean"), 2).alias("perplexity")
    )


def bits_per_char(runs: DataFrame, meta: DataFrame, run: str = "run", val_loss: str = "val_loss") -> DataFrame:
    """Best validation loss in bits per character, comparable across tokenizers."""
    best = runs.groupBy(run).agg(F.min(val_loss).alias("best_val_loss"))
    return best.join(meta, run).withColumn("bpc", F.col("best_val_loss") / F.log(F.lit(2.0)) / F.col("chars_per_token"))


def random_floor(vocab_size: Column) -> tuple[Column, Column]:
    """Loss of guessing: natural log and bits."""
    return F.log(vocab_size.cast("double")), F.log2(vocab_size.cast("double"))


def seed_summary(results: DataFrame, config: str = "config", value: str = "best_val") -> DataFrame:
    """Mean and sample deviation over seeds; one seed has deviation 0."""
    return results.groupBy(config).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("seeds"),
        F.array_sort(F.collect_list(F.struct("seed", value))).alias("values"),
    ).withColumn("values", F.transform("values", lambda v: v[value]))


def significance(summary: DataFrame, baseline: str, config: str = "config") -> DataFrame:
    """A gap to the baseline is real when it exceeds twice the larger deviation."""
    base = summary.where(F.col(config) == baseline)
    base_mean, base_std = base.select("mean").scalar(), base.select("std").scalar()
    gap = base_mean - F.col("mean")
    noise = 2 * F.greatest(F.col("std"), base_std)
    return summary.where(F.col(config) != baseline).select(
        config, gap.alias("gap"), noise.alias("noise"), F.when(F.abs(gap) > noise, F.lit("real")).otherwise(F.lit("noise")).alias("verdict")
    )


def compare_models(scores: DataFrame, a: str, b: str, position: Sequence[str] = ("seq_id", "pos")) -> DataFrame:
    """Mean losses, banded difference and share of equal predictions of two models."""
    # Rows of one position count as all their pairs, a null prediction agrees with none and a null loss is left out.
    own = lambda model, value: F.sum(F.when(F.col("model") == model, value).otherwise(0))
    held = F.col("pred").isNotNull().cast("bigint")
    present = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in position])
    alike = scores.where(present & F.col("model").isin(a, b)).groupBy(*position, "pred").agg(*[
        own(model, value).alias(f"{name}_{side}") for side, model in (("a", a), ("b", b)) for name, value in (
            ("n", F.lit(1)), ("pred", held), ("loss", F.coalesce("loss", F.lit(0.0))), ("losses", F.col("loss").isNotNull().cast("bigint")))])
    sums = [F.sum(f"{name}_{side}").alias(f"{name}_{side}") for side in "ab" for name in ("n", "pred", "loss", "losses")]
    met = alike.groupBy(*position).agg(*sums, F.sum(F.col("pred_a") * F.col("pred_b")).alias("same"))
    over = lambda x, y: F.sum(F.col(x) * F.col(y))
    means = met.agg(
        F.try_divide(over("loss_a", "n_b"), over("losses_a", "n_b")).alias("loss_a"),
        F.try_divide(over("loss_b", "n_a"), over("losses_b", "n_a")).alias("loss_b"),
        F.try_divide(F.sum("same"), over("pred_a", "pred_b")).alias("agreement"),
    )
    delta = F.col("loss_b") - F.col("loss_a")
    verdict = F.when(delta > SAME_BAND, F.lit("b_worse")).when(delta < -SAME_BAND, F.lit("b_better")).otherwise(F.lit("same"))
    return means.select("*", delta.alias("delta"), verdict.alias("verdict"))


def ensemble_losses(scores: DataFrame, position: Sequence[str] = ("seq_id", "pos"), prob: str = "p") -> DataFrame:
    """Loss of the averaged probability next to every single model and the best one."""
    mixed = scores.groupBy(*position).agg(F.avg(prob).alias(prob))
    ensemble = mixed.agg(F.avg(-F.log(F.col(prob) + ENSEMBLE_FLOOR)).alias("loss")).select(F.lit("ensemble").alias("model"), "loss")
    singles = scores.groupBy("model").agg(F.avg(-F.log(prob)).alias("loss"))
    best = singles.agg(F.min("loss")).scalar()
    return singles.unionByName(ensemble).withColumn("gain_over_best", best - F.col("loss"))


# ---- answers ---------------------------------------------------------------

def answer_losses(tokens: DataFrame, model: str = "model", seq: str = "seq_id") -> DataFrame:
    """Mean loss over answer tokens only."""
    return tokens.where((F.col("mask") == 1) & (F.col("pos") >= 1)).groupBy(model, seq).agg(F.avg(-F.col("logp")).alias("loss"))


def answer_win_rate(losses: DataFrame, a: str, b: str, seq: str = "seq_id") -> DataFrame:
    """Answer perplexity of both models and how often ``b`` is strictly better."""
    la = losses.where(F.col("model") == a).select(seq, F.col("loss").alias("loss_a"))
    lb = losses.where(F.col("model") == b).select(seq, F.col("loss").alias("loss_b"))
    return la.join(lb, seq).agg(
        F.count("*").alias("n"), F.exp(F.avg("loss_a")).alias("ppl_a"), F.exp(F.avg("loss_b")).alias("ppl_b"),
        F.avg((F.col("loss_b") < F.col("loss_a")).cast("double")).alias("win_rate"),
    )


def in_answer_form(answer: Column, question: Column, opening: str = "是一", copula: str = "是", head: int = 14, near: int = 6) -> Column:
    """Answer opens like a definition: the fixed phrase, or a question character and an early copula."""
    start = F.substring(answer, 1, head)
    first = F.substring(start, 1, 1)
    echoes = (F.length(first) > 0) & F.contains(question, first) & F.contains(F.substring(start, 1, near), F.lit(copula))
    return F.contains(start, F.lit(opening)) | echoes


# ---- preferences -----------------------------------------------------------

def sequence_logp(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of response log-probabilities and response length, aligned to predicted tokens."""
    return tokens.where((F.col("mask") == 1) & (F.col("pos") >= 1)).groupBy(*keys).agg(
        F.sum("logp").alias("logp"), F.count("*").alias("n_tokens")
    )


def sides(seq_scores: DataFrame, pair: Sequence[str] = ("pair_id",), value: Column | None = None) -> DataFrame:
    """One row per pair with the chosen and the rejected value."""
    v = F.col("logp") if value is None else value
    pick = lambda side: F.max(F.when(F.col("side") == side, v))
    return seq_scores.groupBy(*pair).agg(pick("chosen").alias("chosen"), pick("rejected").alias("rejected")).where(
        F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    )


def preference_accuracy(seq_scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Share of pairs whose chosen side has the higher mean log-probability per token."""
    per_token = F.col("logp") / F.greatest(F.col("n_tokens"), F.lit(1))
    return sides(seq_scores, [*by, "pair_id"], per_token).groupBy(*by).agg(
        F.count("*").alias("pairs"), F.avg((F.col("chosen") > F.col("rejected")).cast("double")).alias("accuracy")
    )


def log_ratio_margins(seq_scores: DataFrame, policy: str = "policy", reference: str = "reference") -> DataFrame:
    """(policy - reference) of chosen minus the same of rejected, per pair."""
    ratio = F.sum(F.when(F.col("model") == policy, F.col("logp")).when(F.col("model") == reference, -F.col("logp")))
    both = F.countDistinct("model") == 2
    ratios = seq_scores.where(F.col("model").isin(policy, reference)).groupBy("pair_id", "side").agg(
        ratio.alias("logp"), both.alias("both")
    ).where("both")
    return sides(ratios).select("pair_id", (F.col("chosen") - F.col("rejected")).alias("margin"))


def log1p_exp(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def _margin_summary(margins: DataFrame, loss: Column) -> DataFrame:
    return margins.agg(
        F.count("*").alias("pairs"), F.avg(loss).alias("loss"), F.avg("margin").alias("margin"),
        F.avg((F.col("margin") > 0).cast("double")).alias("accuracy"),
    )


def logistic_preference_loss(margins: DataFrame, beta: float = 0.1) -> DataFrame:
    return _margin_summary(margins, log1p_exp(-beta * F.col("margin")))


def squared_preference_loss(margins: DataFrame, beta: float = 0.1) -> DataFrame:
    return _margin_summary(margins, F.pow(F.col("margin") - 1.0 / (2.0 * beta), F.lit(2.0)))


PREFERENCE_LOSSES = {"dpo": logistic_preference_loss, "ipo": squared_preference_loss}


def pairwise_reward_loss(rewards: DataFrame) -> DataFrame:
    """Bradley-Terry loss and accuracy from (pair_id, chosen, rejected) scores."""
    return _margin_summary(rewards.withColumn("margin", F.col("chosen") - F.col("rejected")), log1p_exp(-F.col("margin")))


# ---- policy gradients ------------------------------------------------------

def group_advantages(rewards: DataFrame, group: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """(r - mean) / (sample deviation + 1e-6) per prompt; group statistics are joined, so hot prompts stay split."""
    stats = rewards.groupBy(group).agg(F.avg(reward).alias("mean"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("std"))
    return rewards.join(stats, group).withColumn(
        "advantage", (F.col(reward) - F.col("mean")) / (F.col("std") + SPREAD_FLOOR)
    ).drop("mean", "std")


def batch_advantages(rewards: DataFrame, raw: Column) -> DataFrame:
    """Batch-wide variant: reward minus value, standardised over the whole batch."""
    measured = rewards.withColumn("raw", raw)
    mean = measured.agg(F.avg("raw")).scalar()
    std = measured.agg(F.coalesce(F.stddev_samp("raw"), F.lit(0.0))).scalar()
    return measured.withColumn("advantage", (F.col("raw") - mean) / (std + SPREAD_FLOOR)).drop("raw")


def policy_gradient_objective(sequences: DataFrame, beta: float = 0.05) -> DataFrame:
    """mean(-advantage * logp + beta * (logp - ref_logp)) and the mean divergence."""
    kl = F.col("logp") - F.col("ref_logp")
    return sequences.agg(
        F.count("*").alias("sequences"), F.avg(-F.col("advantage") * F.col("logp") + beta * kl).alias("objective"), F.avg(kl).alias("kl")
    )


def clipped_surrogate(tokens: DataFrame, clip_eps: float = 0.2, **means: Column) -> DataFrame:
    """Masked clipped surrogate loss and share of clipped tokens, further masked means by name; eps <= 0 disables clipping.

    The surrogate min(r*A, clip(r)*A) is r*A less what r overshoots its bound
    in the direction that A rewards; without clipping the bound lies at infinity.
    """
    width = clip_eps if clip_eps > 0 else float("inf")
    over = F.greatest(F.abs(F.col("ratio") - 1) - width, F.lit(0.0))
    rewarded = F.signum(F.col("ratio") - 1) * F.col("advantage") > 0
    surrogate = F.col("ratio") * F.col("advantage") - F.when(rewarded, over * F.abs("advantage")).otherwise(0.0)
    outside = F.when(over > 0, F.col("mask")).otherwise(0.0)
    per_token = F.greatest(F.sum("mask"), F.lit(1.0))
    return tokens.agg(
        (-F.sum(surrogate * F.col("mask")) / per_token).alias("loss"), (F.sum(outside) / per_token).alias("clip_frac"),
        *[(F.sum(value * F.col("mask")) / per_token).alias(name) for name, value in means.items()])


def actor_critic_losses(tokens: DataFrame, sequences: DataFrame, clip_eps: float = 0.2, beta: float = 0.02, value_weight: float = 0.5) -> DataFrame:
    """Policy, masked divergence, value loss and their weighted sum."""
    policy = clipped_surrogate(tokens, clip_eps, kl=F.col("logp") - F.col("ref_logp"))
    value = sequences.agg(F.avg(F.pow(F.col("value") - F.col("reward"), F.lit(2.0)))).scalar()
    row = policy.select("loss", "clip_frac", "kl", value.alias("value_loss"))
    return row.select(
        F.col("loss").alias("policy_loss"), "clip_frac", "kl", "value_loss",
        (F.col("loss") + beta * F.col("kl") + value_weight * F.col("value_loss")).alias("loss"),
    )


# ---- generations -----------------------------------------------------------

def repetition(outputs: DataFrame, tokens: str = "tokens", by: Sequence[str] = ()) -> DataFrame:
    """1 - distinct bigrams / bigrams, averaged over outputs that have a bigram."""
    n = F.size(tokens) - 1
    bigrams = F.arrays_zip(F.slice(tokens, 1, F.greatest(n, F.lit(0))), F.slice(tokens, 2, F.greatest(n, F.lit(0))))
    rate = F.when(n > 0, 1 - F.size(F.array_distinct(bigrams)) / n)
    return outputs.groupBy(*by).agg(F.avg(rate).alias("repetition"), F.count(rate).alias("outputs"))


def diversity(outputs: DataFrame, output: str = "output", by: Sequence[str] = ()) -> DataFrame:
    """Distinct outputs over outputs; distinct rows are formed before they are counted."""
    counted = outputs.groupBy(*by, output).agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(
        F.count("*").alias("distinct_outputs"), F.sum("n").alias("outputs"), (F.count("*") / F.sum("n")).alias("diversity")
    )


def reference_drift(seq_scores: DataFrame, policy: str = "policy", reference: str = "reference") -> DataFrame:
    """Mean absolute difference of per-token log-probability, over both responses."""
    per_token = F.col("logp") / F.greatest(F.col("n_tokens"), F.lit(1))
    a = seq_scores.where(F.col("model") == policy).select("pair_id", "side", per_token.alias("a"))
    b = seq_scores.where(F.col("model") == reference).select("pair_id", "side", per_token.alias("b"))
    return a.join(b, ["pair_id", "side"]).agg(F.count("*").alias("responses"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("drift"))


def mean_reward(rewards: DataFrame, by: Sequence[str] = (), prompt: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """Mean over samples of each prompt, then over prompts."""
    return rewards.groupBy(*by, prompt).agg(F.avg(reward).alias("r")).groupBy(*by).agg(
        F.count("*").alias("prompts"), F.avg("r").alias("mean_reward")
    )


# ---- candidate truncation --------------------------------------------------

def truncate_candidates(
    logits: DataFrame, by: Sequence[str], token: str = "token", temperature: float = 1.0,
    top_k: int | None = None, top_p: float | None = None, min_p: float | None = None,
) -> DataFrame:
    """Temperature, then top-k, nucleus and min-p, each on what the previous one left.

    Groups are one vocabulary wide.  Ties at the k-th logit stay; the token
    that crosses the nucleus border stays; probabilities are renormalised.
    """
    z = F.col("logit")
    group = Window.partitionBy(*by)
    left = logits.withColumn("logit", z / temperature)
    if top_k is not None:
        order = Window.partitionBy(*by).orderBy(F.col("logit").desc())
        left = left.withColumn("place", F.rank().over(order)).where(F.col("place") <= top_k).drop("place")
    weight = F.exp(z - F.max("logit").over(group))

    def with_p(table: DataFrame) -> DataFrame:
        return table.withColumn("w", weight).withColumn("p", F.col("w") / F.sum("w").over(group)).drop("w")

    left = with_p(left)
    if top_p is not None:
        earlier = Window.partitionBy(*by).orderBy(F.col("p").desc(), token).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("p").over(earlier), F.lit(0.0))
        left = with_p(left.withColumn("before", before).where(F.col("before") <= top_p).drop("before"))
    if min_p is not None:
        left = with_p(left.withColumn("peak", F.max("p").over(group)).where(F.col("p") >= min_p * F.col("peak")).drop("peak"))
    return left
