"""Timeline rows, their event types and their joins with sessions and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.schemas import EVENT

EVENT_TYPES = ("conversation", "intersection", "session")


def event_type(timeline: DataFrame) -> DataFrame:
    """One row per event: conversation, session or intersection.

    A row without a session counts as a conversation, whatever its conversation id says.
    """
    conversation = F.max(F.col("session_id").isNull())
    session = F.max(F.col("session_id").isNotNull())
    label = (
        F.when(F.col("_c") & ~F.col("_s"), "conversation")
        .when(~F.col("_c") & F.col("_s"), "session")
        .otherwise("intersection")
    )
    return (
        timeline.groupBy(EVENT)
        .agg(conversation.alias("_c"), session.alias("_s"))
        .select(EVENT, label.alias("event"))
    )


def of_modality(timeline: DataFrame, modality: str) -> DataFrame:
    """Timeline rows of one modality, with its id column only."""
    key = f"{modality}_id"
    return timeline.where(F.col(key).isNotNull()).select(EVENT, "event_number", key)


def attach(timeline: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Left join of timeline rows with the rows of their session or conversation.

    Written as matched rows plus unmatched rows: adaptive execution can split a hot key on both
    sides of an inner join, but not on the right side of a left join.
    """
    matched = timeline.join(details, key)
    unmatched = timeline.join(details.select(key).distinct(), key, "left_anti")
    columns = [*timeline.columns, *[c for c in details.columns if c != key]]
    return matched.select(*columns).unionByName(unmatched, allowMissingColumns=True)


def timeline_actions(timeline: DataFrame, sessions: DataFrame) -> DataFrame:
    return attach(of_modality(timeline, "session"), sessions, "session_id")


def timeline_sentences(timeline: DataFrame, sentences: DataFrame) -> DataFrame:
    return attach(of_modality(timeline, "conversation"), sentences, "conversation_id")


def restrict(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows whose event occurs in ``events``."""
    return rows.join(events.select(EVENT), EVENT, "left_semi")


def missing_modality(timeline: DataFrame, modality: str) -> DataFrame:
    """Events without any row of ``modality``."""
    present = timeline.where(F.col(f"{modality}_id").isNotNull())
    return timeline.select(EVENT).distinct().join(present.select(EVENT), EVENT, "left_anti")


def event_spine(timeline: DataFrame, rows: DataFrame) -> DataFrame:
    """Every event of the timeline with its rows, or one row of nulls.

    Matched and unmatched rows apart, as in ``attach``: the rows of a hot event stay where they are.
    """
    events = timeline.select(EVENT).distinct()
    matched = rows.join(events, EVENT, "left_semi")
    unmatched = events.join(rows.select(EVENT).distinct(), EVENT, "left_anti")
    columns = [EVENT, *[c for c in rows.columns if c != EVENT]]
    return matched.select(*columns).unionByName(unmatched, allowMissingColumns=True)


def keyword_timeline(
    timeline: DataFrame, sessions: DataFrame, conversations: DataFrame, keep_empty_events: bool = False
) -> DataFrame:
    """Sentences and actions as one ``(number, keywords)`` table, rows without keywords dropped.

    ``keep_empty_events`` keeps an event that lost every row as one row of nulls: the shape used at
    test time.
    """
    talk = timeline_sentences(timeline, conversations).select(
        EVENT, "event_number", "conversation_id", F.col("sentence_number").alias("number"), "keywords"
    )
    clicks = timeline_actions(timeline, sessions).select(
        EVENT,
        "event_number",
        "session_id",
        F.col("action_number").alias("number"),
        F.col("action_tags").alias("keywords"),
    )
    rows = talk.unionByName(clicks, allowMissingColumns=True).where(
        F.col("keywords").isNotNull() & (F.col("keywords") != "")
    )
    if keep_empty_events:
        rows = event_spine(timeline, rows)
    return rows.select(EVENT, "event_number", "conversation_id", "session_id", "number", "keywords")


def modality_union(conversations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Step rows of both modalities under one schema; columns of the other modality are null."""
    return conversations.unionByName(sessions, allowMissingColumns=True)


def timeline_checks(timeline: DataFrame, purchases: DataFrame, post_filter: DataFrame) -> DataFrame:
    """How often the promises of the tables are broken, one row per promise."""
    events = timeline.select(EVENT).distinct()
    ids = events.agg(
        (F.max(EVENT) + 1 - F.count(F.lit(1)) + F.abs(F.min(EVENT))).cast("long").alias("violations")
    ).withColumn("promise", F.lit("dense event ids from 0"))
    exactly_one = timeline.agg(
        F.count_if(F.col("conversation_id").isNull() == F.col("session_id").isNull()).alias("violations")
    ).withColumn("promise", F.lit("one id per row"))

    def absent(table: DataFrame, promise: str) -> DataFrame:
        # an event once, by shuffle: its rows take a small share of their size in files, by which Spark would broadcast them
        lost = events.join(table.select(EVENT).distinct().hint("merge"), EVENT, "left_anti")
        return lost.agg(F.count(F.lit(1)).alias("violations")).withColumn("promise", F.lit(promise))

    return (
        ids.unionByName(exactly_one)
        .unionByName(absent(purchases, "an item bought per event"))
        .unionByName(absent(post_filter, "an item on sale per event"))
        .select("promise", "violations")
    )
