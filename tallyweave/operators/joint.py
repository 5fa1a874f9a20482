"""Feature sets that use both modalities of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.timeline import modality_union
from tallyweave.schemas import EVENT


def joint_features(conversations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Conversation embeddings and session features side by side.

    The block of the other modality is zero, and so is a gap in an embedding: both are implied. A session
    step has a null ``embedding``, a conversation no features.
    """
    talk = conversations.select(EVENT, "event_number", "conversation_id", "embedding").withColumn(
        "conversation_ind", F.lit(1)
    )
    clicks = sessions.select(EVENT, "event_number", "session_id", "features", "positions").withColumn(
        "conversation_ind", F.lit(0)
    )
    return (
        modality_union(talk, clicks)
        .withColumn("features", F.coalesce("features", F.array().cast("array<string>")))
        .withColumn("positions", F.coalesce("positions", F.array().cast("array<int>")))
        .withColumn("event_number", F.coalesce("event_number", F.lit(0)))
    )
