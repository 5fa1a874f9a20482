"""Ragged step sequences in chunks of bounded size, for handing batches to a trainer.

A chunk holds up to a fixed number of an event's consecutive steps: the features of all its steps one after
another in ``values``, and in ``offsets`` where each step begins. An event of any length spans as many chunks
as it needs, so neither a row nor a task grows with it, and no slot is stored for padding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.features import with_ages
from tallyweave.schemas import EVENT

STEPS = 256


def chunked(steps: DataFrame, tie_breakers: Sequence[str] = (), per_chunk: int = STEPS) -> DataFrame:
    """Event, ``chunk`` (from 0), ``n_steps`` (of the event), ``offsets`` and ``values`` (feature positions).

    Step i of a chunk has the values from ``offsets[i]`` to ``offsets[i + 1]``; it is step
    ``chunk * per_chunk + i`` of its event.
    """
    placed = with_ages(steps, tie_breakers).withColumn("_at", F.col("n_steps") - 1 - F.col("age"))
    cut = placed.groupBy(EVENT, "n_steps", F.floor(F.col("_at") / per_chunk).cast("int").alias("chunk"))
    listed = cut.agg(F.array_sort(F.collect_list(F.struct("_at", "positions"))).alias("_s"))
    sizes = F.transform("_s", lambda s: F.size(s["positions"]))
    offsets = F.transform(F.sequence(F.lit(0), F.size("_s")), lambda i: F.aggregate(F.slice(F.col("_sizes"), 1, i), F.lit(0), lambda a, n: a + n))
    return listed.withColumn("_sizes", sizes).select(EVENT, "chunk", "n_steps", offsets.alias("offsets"), F.flatten("_s.positions").alias("values"))


def slots(chunks: DataFrame, per_chunk: int = STEPS, max_steps: int | None = None) -> DataFrame:
    """The left-padded slots of all steps: event, ``slot`` (from 1), ``n_steps`` and ``positions``.

    The padded length is that of the longest event unless given; a longer event then keeps its latest steps.
    """
    length = chunks.agg(F.max("n_steps")).scalar() if max_steps is None else F.lit(max_steps)
    each = chunks.select(EVENT, "chunk", "n_steps", "offsets", "values", F.posexplode(F.slice("offsets", F.lit(1), F.size("offsets") - 1)).alias("_i", "_from"))
    until = F.element_at("offsets", F.col("_i") + 2)
    step = each.withColumn("positions", F.slice("values", F.col("_from") + 1, until - F.col("_from")))
    placed = step.withColumn("_length", length).withColumn("slot", (F.col("_length") - F.col("n_steps") + F.col("chunk") * per_chunk + F.col("_i") + 1).cast("int"))
    return placed.where("slot > 0").select(EVENT, "slot", F.least("n_steps", "_length").cast("int").alias("n_steps"), "positions")
