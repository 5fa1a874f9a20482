"""Mean embeddings per event and per conversation.

Sentence vectors are summed per conversation *before* the join with the timeline, so the wide rows
are shuffled once, already combined on the map side.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.schemas import EVENT


def _sums_and_counts(embedding):
    """Values with gaps as 0, followed by one 0/1 flag per value: sums then skip the gaps."""
    values = F.transform(embedding, lambda x: F.coalesce(F.nanvl(x, F.lit(None)), F.lit(0.0)).cast("double"))
    flags = F.transform(embedding, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(1.0))
    return F.concat(values, flags)


def _vector_sum(column) -> object:
    return vector_to_array(Summarizer.sum(array_to_vector(column)))


def _mean(parts):
    half = (F.size(parts) / 2).cast("int")
    return F.zip_with(
        F.slice(parts, 1, half), F.slice(parts, half + 1, half), lambda s, n: F.when(n > 0, s / n)
    )


def conversation_sums(sentences: DataFrame, timeline: DataFrame | None = None) -> DataFrame:
    """Per conversation: sums and counts of all its sentence vectors, in one array.

    With a ``timeline`` only its conversations are summed; the others go before the wide rows move.
    """
    if timeline is not None:
        wanted = timeline.where(F.col("conversation_id").isNotNull()).select("conversation_id").distinct()
        sentences = sentences.join(wanted, "conversation_id", "left_semi")
    return (
        sentences.where(F.col("embedding").isNotNull())
        .groupBy("conversation_id")
        .agg(_vector_sum(_sums_and_counts(F.col("embedding"))).alias("_parts"))
    )


def conversation_embedding(timeline: DataFrame, sentences: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Mean sentence vector of each conversation of each event; null where it has no sentence.

    ``sums`` are the conversations' sums if they are at hand; then ``sentences`` isn't read.
    """
    sums = conversation_sums(sentences, timeline) if sums is None else sums
    rows = timeline.where(F.col("conversation_id").isNotNull()).select(EVENT, "event_number", "conversation_id")
    return rows.join(sums, "conversation_id", "left").select(
        EVENT, "event_number", "conversation_id", _mean(F.col("_parts")).alias("embedding")
    )


def event_embedding(timeline: DataFrame, sentences: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Mean over all sentences of all conversations of an event (long conversations weigh more).

    ``sums`` are the conversations' sums if they are at hand; then ``sentences`` isn't read.
    """
    sums = conversation_sums(sentences, timeline) if sums is None else sums
    rows = timeline.where(F.col("conversation_id").isNotNull()).select(EVENT, "conversation_id")
    summed = (
        rows.join(sums, "conversation_id")
        .groupBy(EVENT)
        .agg(_vector_sum(F.col("_parts")).alias("_parts"))
    )
    silent = rows.select(EVENT).distinct().join(summed.select(EVENT), EVENT, "left_anti")
    return summed.select(EVENT, _mean(F.col("_parts")).alias("embedding")).unionByName(
        silent, allowMissingColumns=True
    )


def long_vector(rows: DataFrame, keys: list[str], vector: str = "embedding", name: str = "value") -> DataFrame:
    """One row per vector entry, ``pos`` from 0."""
    return rows.select(*keys, F.posexplode(vector).alias("pos", name))
