"""Training-run logs: one row per run and step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(log: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """Best and final validation loss and the final train/validation gap."""
    final_val = F.max_by("val_loss", step)
    return log.groupBy(run).agg(
        F.min("val_loss").alias("best_val"), final_val.alias("final_val"), (final_val - F.max_by("train_loss", step)).alias("final_gap")
    )


def first_to_last(log: DataFrame, metrics: Sequence[str], run: str = "run", step: str = "step") -> DataFrame:
    """First and last value of every metric per run."""
    ends = [f(m, step).alias(f"{m}_{name}") for m in metrics for name, f in (("first", F.min_by), ("last", F.max_by))]
    return log.groupBy(run).agg(*ends)


def hacking_flags(contrast: DataFrame, proxy: str = "reward", quality: str = "diversity") -> DataFrame:
    """Flag runs whose proxy rose while the real quality fell."""
    up = F.col(f"{proxy}_last") > F.col(f"{proxy}_first")
    down = F.col(f"{quality}_last") < F.col(f"{quality}_first")
    return contrast.select("*", (up & down).alias("proxy_up_quality_down"))


def generalisation_gap(log: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """Last train and held-out accuracy per run and the gap between them."""
    return log.groupBy(run).agg(
        F.max_by("train_acc", step).alias("train_acc"), F.max_by("held_acc", step).alias("held_acc")
    ).withColumn("gap", F.col("train_acc") - F.col("held_acc"))


def generalisation_curve(log: DataFrame, axes: Sequence[str], axis: str = "axis", step: str = "step") -> DataFrame:
    """Held-out accuracy by step, one column per axis."""
    return log.groupBy(step).pivot(axis, list(axes)).agg(F.max("held_acc"))


def loss_by_length(scores: DataFrame, models: Sequence[str], length: str = "length", loss: str = "loss") -> DataFrame:
    """Mean loss per evaluation length, one column per model."""
    return scores.groupBy(length).pivot("model", list(models)).agg(F.avg(loss))
