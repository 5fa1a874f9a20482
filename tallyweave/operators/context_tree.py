"""Items after a session's last steps: a variable-order Markov model with back-off, counted by Spark.

A step's symbol is its rarest feature. The contexts of an event are its last 0, 1, ... DEPTH symbols, the
latest first. The model counts, for every context that occurs, the training events with it and those of
them that bought each item. The share of an item after a context is drawn to its share after the next
shorter one,

    p_d = (n(context, item) + STRENGTH p_(d-1)) / (n(context) + STRENGTH),

contexts that were never seen being passed over. Against the share without any context this gives an odds
ratio, by which the odds of another scorer are multiplied.

Counts are keyed tables: no context, however common, is collected anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.features import with_ages
from tallyweave.schemas import EVENT
from tallyweave.state import stage

DEPTH = 3
STRENGTH = 5.0
BETWEEN = "\x1f"


def symbols(steps: DataFrame, vocabulary: DataFrame, tie_breakers=("session_id",)) -> DataFrame:
    """Event, ``age`` (0 for the last step) and ``symbol`` of each step: its feature with the least count, the
    first by name on ties; ``''`` for a step without features."""
    aged = with_ages(steps, tie_breakers).select(EVENT, "age", "features")
    hits = aged.select(EVENT, "age", F.explode("features").alias("feature"))
    counted = vocabulary.select("feature", F.coalesce("n", F.lit(0)).alias("n"))
    named = hits.join(counted, "feature").groupBy(EVENT, "age").agg(F.min(F.struct("n", "feature"))["feature"].alias("symbol"))
    silent = aged.where(F.size("features") == 0).select(EVENT, "age", F.lit("").alias("symbol"))
    return named.unionByName(silent)


def contexts(symbols: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Event and ``contexts``: the symbols of its last 1, 2, ... steps joined, ``depth`` of them at the most."""
    last = symbols.where(F.col("age") < depth).groupBy(EVENT).agg(F.array_sort(F.collect_list(F.struct("age", "symbol"))).alias("_s"))
    names = F.col("_s.symbol")
    each = F.transform(F.sequence(F.lit(1), F.size("_s")), lambda d: F.array_join(F.slice(names, 1, d), BETWEEN))
    return last.select(EVENT, each.alias("contexts"))


@dataclass(frozen=True)
class ContextTree:
    """``totals``: ``depth``, ``context``, ``n``; ``counts``: the same by ``item_id``. Depth 0 is the empty context."""

    totals: DataFrame
    counts: DataFrame
    depth: int


def _all_contexts(found: DataFrame) -> DataFrame:
    every = F.concat(F.array(F.lit("")), F.col("contexts"))
    return found.select(EVENT, F.posexplode(every).alias("depth", "context"))


def fit(found: DataFrame, labels: DataFrame, depth: int = DEPTH) -> ContextTree:
    """Counts over the events of ``found(event, contexts)``, with what ``labels`` says they bought."""
    each = _all_contexts(found)
    totals = each.groupBy("depth", "context").agg(F.count(F.lit(1)).alias("n"))
    bought = each.join(labels.select(EVENT, "item_id").distinct(), EVENT)
    counts = bought.groupBy("depth", "context", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return ContextTree(stage(totals, "context-totals"), stage(counts, "context-counts"), depth)


def shares(tree: ContextTree, found: DataFrame, wanted: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """Event, item, ``share`` (after the deepest known context) and ``prior`` (without context) of the wanted pairs.

    Pairs of an event that has no contexts have no row. An item that nobody bought has a count of 0.
    """
    events = found
    for d in range(1, tree.depth + 1):
        events = events.withColumn(f"_c{d}", F.try_element_at("contexts", F.lit(d)))
        known = tree.totals.where(F.col("depth") == d).select(F.col("context").alias(f"_c{d}"), F.col("n").alias(f"_n{d}"))
        events = events.join(known, f"_c{d}", "left")
    total = tree.totals.where(F.col("depth") == 0).select("n").scalar()
    pairs = wanted.select(EVENT, "item_id").distinct().join(events.drop("contexts"), EVENT)
    plain = tree.counts.where(F.col("depth") == 0).select("item_id", F.col("n").alias("_k0"))
    pairs = pairs.join(plain, "item_id", "left").withColumn("_all", total)
    prior: Column = (F.coalesce("_k0", F.lit(0)) + F.lit(0.5)) / (F.coalesce("_all", F.lit(0)) + F.lit(1.0))
    pairs, share = pairs.withColumn("prior", prior), F.col("prior")
    for d in range(1, tree.depth + 1):
        seen = tree.counts.where(F.col("depth") == d).select(F.col("context").alias(f"_c{d}"), "item_id", F.col("n").alias(f"_k{d}"))
        pairs = pairs.join(seen, [f"_c{d}", "item_id"], "left")
        after = (F.coalesce(f"_k{d}", F.lit(0)) + F.lit(strength) * share) / (F.col(f"_n{d}") + F.lit(strength))
        pairs = pairs.withColumn(f"_p{d}", F.when(F.col(f"_n{d}").isNull(), share).otherwise(after))
        share = F.col(f"_p{d}")
    return pairs.select(EVENT, "item_id", share.alias("share"), "prior")


def joined(scores: DataFrame, told: DataFrame) -> DataFrame:
    """``scores`` in (0, 1) with their odds multiplied by the odds ratio of ``told``; without a share they stay."""
    odds = F.log(F.col("share") / (1 - F.col("share"))) - F.log(F.col("prior") / (1 - F.col("prior")))
    both = F.log(F.col("score") / (1 - F.col("score"))) + F.coalesce(odds, F.lit(0.0))
    rows = scores.join(told, [EVENT, "item_id"], "left")
    return rows.withColumn("score", 1 / (1 + F.exp(-both))).select(*scores.columns)
