"""Bought items, availability and popularity. Score and label matrices are long keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.schemas import EVENT


def item_labels(purchases: DataFrame) -> DataFrame:
    """Distinct ``(event, item)``; an item cell may hold several ids joined by ``;``."""
    items = F.split(F.col("item_id").cast("string"), ";")
    return purchases.select(EVENT, F.explode(items).alias("item_id")).distinct()


def item_matrix(labels: DataFrame, items: Sequence[str], prefix: str = "item_") -> DataFrame:
    """0/1 column per item. The caller names the items, so no pass over the data looks for them."""
    wide = labels.groupBy(EVENT).pivot("item_id", list(items)).agg(F.count(F.lit(1)))
    return wide.select(EVENT, *[(F.coalesce(F.col(i), F.lit(0)) > 0).cast("int").alias(f"{prefix}{i}") for i in items])


def item_popularity(labels: DataFrame) -> DataFrame:
    return labels.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def popularity_scores(available: DataFrame, popularity: DataFrame) -> DataFrame:
    """Masked popularity score of each available item of each event.

    The score of every other item is 0 by the mask and is implied: events are never multiplied by
    the catalogue.
    """
    score = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    return available.join(popularity, "item_id", "left").select(EVENT, "item_id", score.alias("score"))


def masked_scores(scores: DataFrame, available: DataFrame, drop_unavailable: bool = False) -> DataFrame:
    """Scores with unavailable items set to 0, or left out."""
    keys = [EVENT, "item_id"]
    if drop_unavailable:
        return scores.join(available.select(*keys), keys, "left_semi")
    flagged = available.select(*keys, F.lit(1.0).alias("_on_sale"))
    masked = F.col("score") * F.coalesce("_on_sale", F.lit(0.0))
    return scores.join(flagged, keys, "left").withColumn("score", masked).select(*scores.columns)


def conversation_labels(timeline: DataFrame, labels: DataFrame) -> DataFrame:
    """Bought items repeated for every conversation of their event."""
    rows = timeline.where(F.col("conversation_id").isNotNull()).select(EVENT, "event_number", "conversation_id")
    return rows.join(labels, EVENT)
