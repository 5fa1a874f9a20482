"""Ranking of items per event, ties broken by item id as a string."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import nan_to_null
from tallyweave.functions.positions import range_positions
from tallyweave.schemas import EVENT


def _best_first(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), "item_id")


def _ranking_keys(scores: DataFrame) -> list[str]:
    return [c for c in ("run", EVENT) if c in scores.columns]


def ranked_items(scores: DataFrame) -> DataFrame:
    """Rank of every scored item, from 1. An event has one row per catalogue item at most."""
    keys = _ranking_keys(scores)
    clean = scores.withColumn("score", nan_to_null(F.col("score")))
    return clean.withColumn("rank", F.row_number().over(_best_first(keys)))


def topk_items(scores: DataFrame, k: int) -> DataFrame:
    """The first ``k`` items. The bound reaches the shuffle: each task sends at most ``k`` rows per event."""
    return ranked_items(scores).where(F.col("rank") <= k)


def catalogue(items: DataFrame) -> DataFrame:
    """``item_id`` and ``place``, its number in item order from 1, stored once for all rankings."""
    return range_positions(items.select("item_id").distinct(), "item_id", "place")


def topk_sparse(scores: DataFrame, events: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Top ``k`` where items without a stored score count as 0; stored scores may be negative, zero or NaN.

    Items that count as 0 follow the positive ones in item order, then come the negative ones. The
    fillers of an event are the first of the catalogue that it has no stored score for. They are
    found without matching events with the catalogue: of an event's ``s`` stored items that count
    less than 0 or rank last, those that stand among the catalogue's first are numbered in item order,
    and each of them moves the later fillers on by one place. An event needs as many fillers as it
    lacks positive scores, ``k`` at most, so its fillers lie among the first ``k + s`` items.

    Scores and events are dealt out by event once. Both numberings, by score and by place, and the
    event's counts follow there, so the rank of a filler is known before its name, and nothing goes
    back to its event. ``items`` may be a ``catalogue`` or any table of items.
    """
    keys = _ranking_keys(scores)
    places = items if "place" in items.columns else catalogue(items)
    number = places.agg(F.count(F.lit(1))).scalar()
    known = scores.select(*keys, "item_id", nan_to_null(F.col("score")).alias("score")).where("score is null or score <> 0")
    stored = known.join(places.select("item_id", "place"), "item_id", "left").withColumn("_stored", F.lit(True))
    spine = events.select(*keys).withColumn("_stored", F.lit(False))
    rows = stored.unionByName(spine, allowMissingColumns=True)
    # the n-th filler stands at place n + (stored items before it): a stored item at place p with r
    # stored ones up to it pushes on all fillers from number p - r + 1
    best = Window.partitionBy(*keys).orderBy(F.col("_stored").desc(), F.col("score").desc_nulls_last(), "item_id")
    nth = Window.partitionBy(*keys).orderBy(F.col("place").asc_nulls_last())
    placed = rows.withColumn("_rank", F.row_number().over(best)).withColumn("_from", F.col("place") - F.row_number().over(nth) + 1)
    first = F.when(F.col("_stored") & (F.col("_rank") <= k), F.struct("_rank", "item_id", "score"))
    by_event = placed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(first)).alias("_best"),
        F.count_if(F.col("score") > 0).alias("_above"),
        F.count("place").alias("_taken"),
        F.array(*[F.count_if(F.col("_from") <= n) for n in range(1, k + 1)]).alias("_pushed"),
        F.bool_or(~F.col("_stored")).alias("_wanted"),
    ).withColumn("_number", number)
    fillers = F.transform("_pushed", lambda by, i: F.struct((F.col("_above") + i + 1).alias("rank"), (by + i + 1).alias("place")))
    # beyond the catalogue's end there are no fillers, and the negative scores move up
    missing = F.greatest(F.col("_number") - F.col("_taken"), F.lit(0))
    own = F.transform(
        "_best",
        lambda b: F.struct(
            (b["_rank"] + F.when(~F.col("_wanted") | (b["score"] > 0), F.lit(0)).otherwise(missing)).alias("rank"),
            F.lit(None).cast("long").alias("place"),
            b["item_id"].alias("item_id"),
            b["score"].alias("score"),
        ),
    )
    zeros = F.transform(
        F.filter(fillers, lambda f: f["place"] <= F.col("_number")),
        lambda f: F.struct(f["rank"].alias("rank"), f["place"].cast("long").alias("place"), F.lit(None).cast("string").alias("item_id"), F.lit(0.0).alias("score")),
    )
    both = F.when(F.col("_wanted"), F.concat(own, zeros)).otherwise(own)
    ranked = by_event.select(*keys, F.explode(both).alias("_r")).select(*keys, "_r.*").where(F.col("rank") <= k)
    names = places.select("place", F.col("item_id").alias("_name"))
    return ranked.join(names, "place", "left").select(
        *keys, F.coalesce("item_id", "_name").alias("item_id"), "score", F.col("rank").cast("int").alias("rank")
    )
