"""Shares of event types and the weights derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.schemas import EVENT


def event_type_share(types: DataFrame) -> DataFrame:
    total = types.agg(F.count(F.lit(1))).scalar()
    counts = types.groupBy("event").agg(F.count(F.lit(1)).alias("n_events"))
    return counts.withColumn("share", F.col("n_events") / total)


def _share(label: str) -> Column:
    return F.count_if(F.col("event") == label) / F.count(F.lit(1))


def sample_weights(types: DataFrame, conversation_weight: float = 2.0) -> DataFrame:
    """Weight of each event: fixed for conversations, 1 for sessions, derived for intersections.

    A type that does not occur counts as share 0; the derived weight is null if every event is an
    intersection.
    """
    derived = types.agg(
        F.try_divide(
            F.lit(conversation_weight) * _share("conversation") + _share("session"),
            F.lit(1.0) - _share("intersection"),
        )
    ).scalar()
    weight = (
        F.when(F.col("event") == "conversation", F.lit(conversation_weight))
        .when(F.col("event") == "session", F.lit(1.0))
        .otherwise(derived)
    )
    return types.select(EVENT, "event", weight.alias("weight"))


def distillation_weights(types: DataFrame) -> DataFrame:
    """``alpha``: share of events with a conversation; ``beta``: with a session."""
    both = _share("intersection")
    return types.agg((_share("conversation") + both).alias("alpha"), (_share("session") + both).alias("beta"))
