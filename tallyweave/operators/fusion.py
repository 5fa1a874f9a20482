"""Combining scores of several models, and the targets and loss of a distilled one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.schemas import EVENT

CLIP = 1e-7


def late_fusion(conversation: DataFrame, session: DataFrame, types: DataFrame) -> DataFrame:
    """Conversation events take the conversation scores, session events the session scores,
    intersections the mean of both. Unmasked on both sides; one shuffle, keyed by event."""
    both = conversation.withColumn("_from", F.lit("conversation")).unionByName(
        session.withColumn("_from", F.lit("session"))
    )
    keys = [c for c in ("run", EVENT) if c in conversation.columns]
    owner = F.col("event").isin("intersection", F.col("_from"))
    fused = (
        both.join(types.select(EVENT, "event"), EVENT)
        .where(owner)
        .groupBy(*keys, "item_id", "event")
        .agg(F.avg("score").alias("_mean"), F.count("score").alias("_n"))
    )
    needed = F.when(F.col("event") == "intersection", 2).otherwise(1)
    score = F.when(F.col("_n") == needed, F.col("_mean"))
    return fused.select(*keys, "item_id", score.alias("score"))


def routed_scores(by_type: dict[str, DataFrame], types: DataFrame) -> DataFrame:
    """Each event takes the scores of the model in charge of its type."""
    parts = [scores.withColumn("event", F.lit(label)) for label, scores in by_type.items()]
    together = reduce(lambda a, b: a.unionByName(b), parts)
    return together.join(types.select(EVENT, "event"), [EVENT, "event"], "left_semi").drop("event")


def distillation_targets(labels: DataFrame, conversation: DataFrame, session: DataFrame) -> DataFrame:
    """``y`` (bought), ``z1`` and ``z2`` (teacher scores) of each event and item both teachers score."""
    keys = [EVENT, "item_id"]
    return (
        conversation.select(*keys, F.col("score").alias("z1"))
        .join(session.select(*keys, F.col("score").alias("z2")), keys)
        .join(labels.select(*keys, F.lit(1.0).alias("y")), keys, "left")
        .select(*keys, F.coalesce("y", F.lit(0.0)).alias("y"), "z1", "z2")
    )


def cross_entropy(target: Column, predicted: Column) -> Column:
    p = F.greatest(F.least(predicted, F.lit(1 - CLIP)), F.lit(CLIP))
    return -(target * F.log(p) + (1 - target) * F.log(1 - p))


def distillation_loss(targets: DataFrame, predicted: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean over items of the cross entropy against ``y``, plus ``alpha`` and ``beta`` times that
    against each teacher, per event."""
    alpha, beta = weights.select("alpha").scalar(), weights.select("beta").scalar()
    p = F.col("score")
    loss = (
        cross_entropy(F.col("y"), p)
        + alpha * cross_entropy(F.col("z1"), p)
        + beta * cross_entropy(F.col("z2"), p)
    )
    keys = [EVENT, "item_id"]
    return (
        targets.join(predicted.select(*keys, "score"), keys)
        .withColumn("_loss", loss)
        .groupBy(EVENT)
        .agg(F.avg("_loss").alias("loss"))
    )
