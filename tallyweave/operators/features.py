"""Tag features: share, pruning, multi-hot steps and their left-padded slots.

A *step* is one session or conversation of an event. Steps carry the sorted list of their features
instead of a dense 0/1 row; its length is bounded by the vocabulary, which the share cut bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import seeded_order
from tallyweave.functions.positions import with_positions
from tallyweave.schemas import EVENT
from tallyweave.state import stage

MIN_SHARE = 0.001


def explode_features(rows: DataFrame, features: str) -> DataFrame:
    """One row per entry of the comma list, with its place; a null list gives no row."""
    others = [c for c in rows.columns if c != features]
    return rows.select(*others, F.posexplode(F.split(features, ",")).alias("_place", "feature"))


def feature_share(rows: DataFrame, features: str, row_keys: Sequence[str]) -> DataFrame:
    """Occurrences of each feature per distinct row key; rows without features count in the total."""
    total = rows.select(*row_keys).distinct().agg(F.count(F.lit(1))).scalar()
    counts = explode_features(rows.select(features), features).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("share", F.col("n") / total)


def frequent(shares: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    return shares.where(F.col("share") >= F.lit(min_share))


def prune_long(rows: DataFrame, features: str, shares: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Feature rows with a share of at least ``min_share``.

    At most ``features per row / min_share`` features pass the cut, however large the data. Stored
    vocabularies carry their size, so Spark broadcasts them while they are below its threshold and
    joins by shuffle, splitting hot features, beyond it.
    """
    return explode_features(rows, features).join(_kept(shares, min_share), "feature")


def _kept(shares: DataFrame, min_share: float) -> DataFrame:
    kept = frequent(shares, min_share)
    return kept.select(*[c for c in ("feature", "position") if c in kept.columns])


def prune(
    rows: DataFrame,
    features: str,
    shares: DataFrame,
    id_columns: Sequence[str],
    number: str,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Rows with their frequent features rejoined in order.

    Rows that lose every feature vanish, unless their whole event does: that event keeps one row
    with the feature ``''`` and null ids and numbers.
    """
    keys = [EVENT, "event_number", *id_columns, number]
    kept = (
        prune_long(rows.select(*keys, features), features, shares, min_share)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_place", "feature"))).alias("_f"))
        .select(*keys, F.array_join(F.col("_f.feature"), ",").alias(features))
    )
    emptied = _emptied_events(rows, kept).withColumn(features, F.lit(""))
    return kept.unionByName(emptied, allowMissingColumns=True)


def _emptied_events(rows: DataFrame, kept: DataFrame) -> DataFrame:
    return rows.select(EVENT).distinct().join(kept.select(EVENT).distinct(), EVENT, "left_anti")


def fit_vocabulary(
    rows: DataFrame, features: str, row_keys: Sequence[str], min_share: float = MIN_SHARE
) -> DataFrame:
    """Fitted state of pruning and encoding: ``feature, n, share, position``, in string order from 0.

    ``''`` joins the classes (with null counts) when some fitted event lost all its features.
    """
    shares = stage(frequent(feature_share(rows, features, row_keys), min_share), "frequent")
    kept = prune_long(rows.select(EVENT, features), features, shares, min_share)
    emptied = _emptied_events(rows, kept).limit(1).select(F.lit("").alias("feature"))
    classes = (
        shares.unionByName(emptied, allowMissingColumns=True)
        .groupBy("feature")
        .agg(F.max("n").alias("n"), F.max("share").alias("share"))
    )
    # the share cut bounds the classes, so numbering them in one task is safe
    return classes.withColumn("position", F.row_number().over(Window.orderBy("feature")) - 1)


def encode_steps(
    rows: DataFrame,
    features: str,
    vocabulary: DataFrame,
    id_columns: Sequence[str],
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Multi-hot, max-pooled steps: ``event, event_number, ids, features, positions``.

    Equal features of one step collapse. An event without a known feature keeps one step with null
    ids, holding ``''`` only if that is a class.
    """
    keys = [EVENT, "event_number", *id_columns]
    classes = vocabulary.select("feature", "position", "share")
    known = prune_long(rows.select(*keys, features), features, classes, min_share)
    steps = (
        known.groupBy(*keys)
        .agg(F.array_sort(F.collect_set(F.struct("position", "feature"))).alias("_hits"))
        .select(
            *keys,
            F.col("_hits.feature").alias("features"),
            F.col("_hits.position").alias("positions"),
        )
    )
    blank = classes.where(F.col("feature") == "").select("position").scalar()
    emptied = _emptied_events(rows, known).select(
        EVENT,
        F.when(blank.isNotNull(), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")).alias("features"),
        F.array_compact(F.array(blank)).alias("positions"),
    )
    return steps.unionByName(emptied, allowMissingColumns=True).select(*steps.columns)


def event_bucket() -> Column:
    """Steps of one event are numbered in blocks of event numbers; a step without one comes last."""
    last = F.lit(2_147_483_647)
    return F.floor(F.coalesce("event_number", last) / F.lit(4096)).cast("long")


def with_ages(steps: DataFrame, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Steps of an event counted back from its last one, which has ``age`` 0; ``n_steps`` in all."""
    order = [F.col("event_number").asc_nulls_last(), *tie_breakers]
    return _aged(with_positions(steps, [EVENT], event_bucket(), order, "_position", total="n_steps"))


def _aged(placed: DataFrame) -> DataFrame:
    age = (F.col("n_steps") - F.col("_position")).cast("int")
    return placed.withColumn("age", age).withColumn("n_steps", F.col("n_steps").cast("int")).drop("_position")


def padded_slots(steps: DataFrame, tie_breakers: Sequence[str] = (), max_steps: int | None = None) -> DataFrame:
    """Slot of each step in its event's left-padded sequence, ``1..max_steps``.

    The length is that of the longest event of the batch unless given. Slots before an event's
    first step are its padding: they are implied, not stored, so one very long event does not blow
    up all others. ``n_steps`` says how many slots are filled. Where ``max_steps`` is given, an event that
    is longer keeps its latest steps, and ``n_steps`` counts those.
    """
    return _right_align(with_ages(steps, tie_breakers), steps, max_steps)


def shuffled_slots(
    steps: DataFrame, seed: int, tie_breakers: Sequence[str] = (), max_steps: int | None = None
) -> DataFrame:
    """As ``padded_slots``, but the steps of an event in a seeded pseudo-random order.

    ``tie_breakers`` are whole numbers; they and the event number tell steps apart. The order is that of
    the portable generator, applied twice so that small numbers part too; any engine can repeat it.
    """
    told = sum((F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("event_number", *tie_breakers)), F.lit(7_919 * seed))
    drawn = steps.withColumn("_drawn", seeded_order(seeded_order(told, seed), seed))
    order = ["_drawn", "event_number", *tie_breakers]
    placed = with_positions(drawn, [EVENT], F.shiftright("_drawn", 15), order, "_position", total="n_steps")
    return _right_align(_aged(placed).drop("_drawn"), steps, max_steps)


def _right_align(aged: DataFrame, steps: DataFrame, max_steps: int | None) -> DataFrame:
    if max_steps is None:
        length = steps.groupBy(EVENT).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    else:
        length = F.lit(max_steps)
        aged = aged.where(F.col("age") < max_steps).withColumn("n_steps", F.least("n_steps", F.lit(max_steps)))
    return aged.withColumn("slot", (length - F.col("age")).cast("int")).drop("age")


def session_slots(rows: DataFrame, vocabulary: DataFrame, max_steps: int | None = None) -> DataFrame:
    """Prune, encode and place the sessions of events with a fitted vocabulary.

    Placing reads the steps more than once, so they are written first.
    """
    steps = stage(encode_steps(rows, "action_tags", vocabulary, ["session_id"]), "slot-steps")
    return padded_slots(steps, ["session_id"], max_steps)


def keyword_features(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Encoded steps of both modalities with a conversation indicator.

    The indicator is set after pruning from the missing session id, so an event that lost every
    keyword reads as a conversation.
    """
    steps = encode_steps(rows, "keywords", vocabulary, ["conversation_id", "session_id"])
    return steps.withColumn("conversation_ind", F.col("session_id").isNull().cast("int"))


def long_features(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per step and feature; a step without features gives one row with a null feature."""
    return steps.select(*keys, F.explode_outer("features").alias("feature"))
