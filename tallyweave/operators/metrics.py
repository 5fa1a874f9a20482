"""Ranking metrics per event, their reports by event type, and macro AUC over items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import nan_to_null
from tallyweave.operators.timeline import EVENT_TYPES
from tallyweave.schemas import EVENT

UNION = "union"


def event_metrics(top: DataFrame, labels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """All metrics of each (run,) event and cutoff ``k`` from one ranking.

    ``top`` holds at least the first ``max(ks)`` ranks. Without labels recall and average precision
    are null and the others 0; precision divides by ``k`` even where fewer items exist.
    """
    keys = [c for c in ("run", EVENT) if c in top.columns]
    sizes = labels.groupBy(EVENT).agg(F.count(F.lit(1)).alias("n_labels"))
    relevant = labels.select(EVENT, "item_id", F.lit(1).alias("_rel"))
    so_far = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (
        top.where(F.col("rank") <= max(ks))
        .join(relevant, [EVENT, "item_id"], "left")
        .withColumn("_rel", F.coalesce("_rel", F.lit(0)))
        .withColumn("_hits", F.sum("_rel").over(so_far))
    )
    cutoffs = F.filter(F.lit(sorted(set(ks))), lambda k: k >= F.col("rank"))
    per_k = (
        hits.withColumn("k", F.explode(cutoffs))
        .groupBy(*keys, "k")
        .agg(
            F.max("_rel").cast("double").alias("hit"),
            F.sum("_rel").alias("_captured"),
            F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("_first"),
            F.sum(F.col("_rel") * F.col("_hits") / F.col("rank")).alias("_gain"),
        )
    )
    n = F.coalesce("n_labels", F.lit(0))
    return per_k.join(sizes, EVENT, "left").select(
        *keys,
        "k",
        "hit",
        (F.col("_captured") / F.col("k")).alias("precision"),
        F.try_divide("_captured", n).alias("recall"),
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.try_divide("_gain", F.least(F.col("k"), n)).alias("average_precision"),
    )


def metrics_by_type(
    types: DataFrame, metrics: DataFrame, runs: Sequence[int] | None = None, union: bool = True
) -> DataFrame:
    """Mean metrics per run and event type, and over all events as ``union``.

    A type whose events have no metrics shows with null means, not as a gap. Single-modality
    reports leave the union row out.
    """
    keys = [EVENT]
    spine = types.select(EVENT, "event")
    if runs is not None:
        spine = spine.withColumn("run", F.explode(F.lit(list(runs))))
        keys = ["run", EVENT]
    joined = spine.join(metrics, keys, "left")
    by_run = ["run"] if runs is not None else []
    means = [
        F.count(F.lit(1)).alias("n_events"),
        F.avg("hit").alias("hit_rate"),
        F.avg("average_precision").alias("mean_average_precision"),
    ]
    if not union:
        return joined.groupBy(*by_run, "event").agg(*means)
    sets = [[*by_run, "event"], by_run]
    grouped = joined.groupingSets(sets, *by_run, "event").agg(F.grouping("event").alias("_all"), *means)
    label = F.when(F.col("_all") == 1, UNION).otherwise(F.col("event"))
    return grouped.withColumn("event", label).drop("_all")


def evaluation_report(types: DataFrame, metrics: DataFrame, ks: Sequence[int], union: bool = True) -> DataFrame:
    """Mean metrics of one run per cutoff and event type, types without scores showing as null."""
    spine = types.select(EVENT, "event").withColumn("k", F.explode(F.lit(list(ks))))
    joined = spine.join(metrics, [EVENT, "k"], "left")
    means = [
        F.avg("hit").alias("hit_rate"),
        F.avg("average_precision").alias("mean_average_precision"),
    ]
    if not union:
        return joined.groupBy("event", "k").agg(*means)
    grouped = joined.groupingSets([["k", "event"], ["k"]], "k", "event").agg(
        F.grouping("event").alias("_all"), *means
    )
    label = F.when(F.col("_all") == 1, UNION).otherwise(F.col("event"))
    return grouped.withColumn("event", label).drop("_all")


def metrics_over_runs(by_type: DataFrame) -> DataFrame:
    return by_type.groupBy("event").agg(
        F.avg("hit_rate").alias("hit_rate"),
        F.avg("mean_average_precision").alias("mean_average_precision"),
    )


def map_by_k(
    types: DataFrame, metrics: DataFrame, runs: Sequence[int], ks: Sequence[int], union: bool = True
) -> DataFrame:
    """Mean average precision by cutoff (rows) and event type (columns), averaged over runs."""
    spine = types.select(EVENT, "event").withColumn("run", F.explode(F.lit(list(runs)))).withColumn(
        "k", F.explode(F.lit(list(ks)))
    )
    value = F.avg("average_precision").alias("map")
    joined = spine.join(metrics, ["run", EVENT, "k"], "left")
    sets = [["run", "k", "event"], ["run", "k"]] if union else [["run", "k", "event"]]
    per_run = joined.groupingSets(sets, "run", "k", "event").agg(F.grouping("event").alias("_all"), value)
    label = F.when(F.col("_all") == 1, UNION).otherwise(F.col("event"))
    columns = [*EVENT_TYPES, *([UNION] if union else [])]
    return per_run.withColumn("event", label).groupBy("k").pivot("event", columns).agg(F.avg("map"))


def item_auc(
    scores: DataFrame, labels: DataFrame, events: DataFrame, runs: Sequence[int] | None = None
) -> DataFrame:
    """ROC AUC of each item over ``events``, from masked scores.

    Scores that are not stored count as 0, so masked-out pairs need no rows: every item starts with
    all events at score 0, and each stored score moves one event away from there. Equal scores are
    collapsed to counts before they are cut into ranges by ``(item, score)``, so an item with any
    number of distinct scores is shared by many tasks; only one total per range meets in one place.
    """
    keys = [*(["run"] if runs is not None else []), "item_id"]
    wanted = events.select(EVENT).distinct()
    n_events = wanted.agg(F.count(F.lit(1))).scalar()
    positives = labels.select(EVENT, "item_id").join(wanted, EVENT, "left_semi").distinct()
    stored = (
        scores.withColumn("score", nan_to_null(F.col("score")))
        .where(F.col("score") != 0)
        .join(wanted, EVENT, "left_semi")
        .join(positives.withColumn("_y", F.lit(1)), [EVENT, "item_id"], "left")
    )
    y = F.coalesce("_y", F.lit(0)).cast("long")

    def change(score, pos, neg):
        return F.struct(
            score.cast("double").alias("score"), pos.cast("long").alias("pos"), neg.cast("long").alias("neg")
        )

    moved = stored.select(
        *keys, F.explode(F.array(change(F.col("score"), y, 1 - y), change(F.lit(0.0), -y, y - 1))).alias("_c")
    )
    bought = positives.select("item_id", change(F.lit(0.0), F.lit(1), F.lit(-1)).alias("_c"))
    items = positives.select("item_id").unionByName(scores.select("item_id")).distinct()
    start = items.select("item_id", change(F.lit(0.0), F.lit(0), n_events).alias("_c"))
    at_zero = bought.unionByName(start)
    if runs is not None:
        at_zero = at_zero.withColumn("run", F.explode(F.lit(list(runs))))
    counts = (
        moved.unionByName(at_zero)
        .groupBy(*keys, F.col("_c.score").alias("score"))
        .agg(F.sum("_c.pos").alias("pos"), F.sum("_c.neg").alias("neg"))
    )
    ranges = counts.repartitionByRange(*keys, "score").withColumn("_range", F.spark_partition_id())
    lower = Window.partitionBy(*keys, "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("pos") * (F.coalesce(F.sum("neg").over(lower), F.lit(0)) + F.col("neg") / 2)
    per_range = (
        ranges.withColumn("_wins", pairs)
        .groupBy(*keys, "_range")
        .agg(F.sum("_wins").alias("_wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("_wins") + F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0))
    return (
        per_range.withColumn("_wins", wins)
        .groupBy(*keys)
        .agg(F.sum("_wins").alias("_wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
        .select(*keys, "n_pos", "n_neg", F.try_divide("_wins", F.col("n_pos") * F.col("n_neg")).alias("auc"))
    )


def macro_auc(
    scores: DataFrame, labels: DataFrame, events: DataFrame, runs: Sequence[int] | None = None
) -> DataFrame:
    """Plain mean of the item AUCs; items seen with one class only are left out and counted."""
    per_item = item_auc(scores, labels, events, runs)
    by_run = ["run"] if runs is not None else []
    return per_item.groupBy(*by_run).agg(
        F.avg("auc").alias("macro_auc"),
        F.count("auc").alias("n_items"),
        F.count_if(F.col("auc").isNull()).alias("n_skipped"),
    )
