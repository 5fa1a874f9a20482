"""Schemas of the input tables. Readers always pass one, so no file is scanned to guess types."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = "purchase_event_id"

USERS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("purchase_event_id", T.LongType()),
    T.StructField("conversation_id", T.LongType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("event_number", T.IntegerType()),
])

SESSIONS = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("action_number", T.IntegerType()),
    T.StructField("action_tags", T.StringType()),
])

CONVERSATIONS_KEYWORD = T.StructType([
    T.StructField("conversation_id", T.LongType()),
    T.StructField("sentence_number", T.IntegerType()),
    T.StructField("sentence_speaker", T.StringType()),
    T.StructField("keywords", T.StringType()),
])

CONVERSATIONS_EMBEDDING = T.StructType([
    T.StructField("conversation_id", T.LongType()),
    T.StructField("sentence_number", T.IntegerType()),
    T.StructField("sentence_speaker", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

PURCHASE_EVENTS = T.StructType([
    T.StructField("purchase_event_id", T.LongType()),
    T.StructField("item_id", T.StringType()),
])

POST_FILTER = PURCHASE_EVENTS


def wide_embedding(width: int, prefix: str = "embedding_") -> T.StructType:
    """Schema of one embedding shard: three keys and ``width`` numbered float columns."""
    keys = CONVERSATIONS_EMBEDDING.fields[:3]
    return T.StructType(keys + [T.StructField(f"{prefix}{i}", T.FloatType()) for i in range(1, width + 1)])
