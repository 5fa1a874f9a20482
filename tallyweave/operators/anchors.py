"""Anchor events and the cosine of every step with every anchor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.batches import scattered
from tallyweave.functions.columns import seeded_order
from tallyweave.functions.positions import id_bucket, with_positions
from tallyweave.functions.products import Rows, products
from tallyweave.schemas import EVENT
from tallyweave.state import stage

N_ANCHORS = 125
ANCHOR_BLOCK = 2048  # anchors of one matrix, the most that is ever broadcast
STEP_GROUP = 4096  # steps that meet a block of anchors in one task


def anchor_candidates(timeline: DataFrame) -> DataFrame:
    """Events with exactly one conversation row and one session row."""
    return (
        timeline.groupBy(EVENT)
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("session_id").isNull()).alias("_c"))
        .where((F.col("_n") == 2) & (F.col("_c") == 1))
        .select(EVENT)
    )


def anchor_quota(labels: DataFrame, n_anchors: int = N_ANCHORS) -> DataFrame:
    """Anchors wanted per item: its share of all purchases, rounded half to even, one at least."""
    total = labels.agg(F.count(F.lit(1))).scalar()
    wanted = F.bround(F.count(F.lit(1)) / total * n_anchors, 0)
    return labels.groupBy("item_id").agg(F.greatest(wanted, F.lit(1.0)).cast("int").alias("quota"))


def anchor_class(candidates: DataFrame, labels: DataFrame, quotas: DataFrame) -> DataFrame:
    """Class of a candidate: its bought item with the smallest quota, the first item on ties."""
    rarest = F.min(F.struct("quota", "item_id")).alias("_class")
    return (
        candidates.join(labels, EVENT)
        .join(quotas, "item_id")
        .groupBy(EVENT)
        .agg(rarest)
        .select(EVENT, F.col("_class.item_id").alias("class"), F.col("_class.quota").alias("quota"))
    )


def anchor_sample(classes: DataFrame, n_anchors: int = N_ANCHORS, seed: int = 42) -> DataFrame:
    """Up to ``quota`` events per class in a seeded order, with their position by event id.

    A class with too few candidates gives all it has.
    """
    order = Window.partitionBy("class").orderBy(seeded_order(F.col(EVENT), seed), EVENT)
    ranked = classes.withColumn("_rank", F.row_number().over(order))
    # no quota exceeds max(n_anchors, 1): the constant lets each task drop rows before the shuffle
    chosen = ranked.where((F.col("_rank") <= max(n_anchors, 1)) & (F.col("_rank") <= F.col("quota")))
    placed = with_positions(chosen, [], id_bucket(EVENT), [EVENT], "anchor_pos")
    return placed.select(F.col("anchor_pos").cast("int").alias("anchor_pos"), EVENT, "class")


def anchor_shortfall(classes: DataFrame, quotas: DataFrame) -> DataFrame:
    """Items whose candidates do not fill their quota."""
    found = classes.groupBy(F.col("class").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))
    missing = F.col("quota") - F.coalesce("n", F.lit(0))
    return quotas.join(found, "item_id", "left").where(missing > 0).select(
        "item_id", "quota", missing.alias("missing")
    )


def anchor_vectors(anchors: DataFrame, steps: DataFrame, vector: str) -> DataFrame:
    """Vector of each anchor in one modality: ``anchor_pos, vector``."""
    return anchors.join(steps, EVENT).select("anchor_pos", F.col(vector).alias("vector"))


def _dense(values: pd.Series, width: int | None) -> np.ndarray:
    """Rows of a matrix: plain vectors, or 0/1 rows given by the places of their ones."""
    if width is None:
        length = max((len(v) for v in values if v is not None), default=0)
        rows = [np.zeros(length) if v is None else np.asarray(v, dtype=float) for v in values]
        return np.nan_to_num(np.vstack(rows))
    return scattered(values, width)


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def relative_representation(
    steps: DataFrame, anchors: DataFrame, vector: str, width: int | None = None, block: int = ANCHOR_BLOCK
) -> DataFrame:
    """Replace ``vector`` by ``relative``: the cosines with all anchors in ``anchor_pos`` order.

    ``width`` marks vectors given as places of ones. Steps are never multiplied with anchors as rows. Up to
    ``block`` anchors travel to each executor as one matrix and the batches of steps are multiplied where
    they are; more anchors meet the steps by ``relative_blocks``. A zero vector has cosine 0 with everything.
    """
    spark = steps.sparkSession
    last = anchors.agg(F.max("anchor_pos")).first()[0] or 0
    others = [c for c in steps.columns if c != vector]
    if not last:
        return steps.select(*others, F.array().cast("array<double>").alias("relative"))
    if last <= block:
        values = anchors.orderBy("anchor_pos").toPandas()["vector"]
        matrix = spark.sparkContext.broadcast(_unit(_dense(values, width)).T)
        return steps.select(*others, _cosines(matrix, width)(F.col(vector)).alias("relative"))
    rows = stage(steps.withColumn("_step", F.monotonically_increasing_id()), "relative-steps")
    found = relative_blocks(rows.select("_step", F.col(vector).alias("vector")), anchors, last, width, block)
    whole = found.groupBy("_step").agg(F.array_sort(F.collect_list(F.struct("block", "cosines"))).alias("_c"))
    return rows.join(whole, "_step").select(*others, F.flatten("_c.cosines").alias("relative"))


def relative_blocks(
    steps: DataFrame, anchors: DataFrame, last: int, width: int | None = None, block: int = ANCHOR_BLOCK, group: int = STEP_GROUP
) -> DataFrame:
    """``_step``, ``block`` (from 0) and ``cosines`` with the anchors of the block, for any number of anchors.

    A matrix product by blocks: groups of about ``group`` steps, told by a hash, meet blocks of anchors as
    keyed tables. Nothing is collected or broadcast, and a task holds one block and one group.
    """
    blocks = -(-last // block)
    groups = max(1, -(-steps.count() // group))
    left = steps.select("_step", "vector", F.pmod(F.xxhash64("_step"), F.lit(groups)).cast("int").alias("group"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.select("anchor_pos", F.col("vector").alias("anchor"), F.floor((F.col("anchor_pos") - 1) / block).cast("int").alias("block"))
    right = right.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def work(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame(columns=["_step", "block", "cosines"])
        fixed = _unit(_dense(theirs.sort_values("anchor_pos")["anchor"], width))
        rows = _dense(mine["vector"], width)
        if rows.shape[1] != fixed.shape[1]:  # a group of missing vectors only
            rows = np.zeros((len(rows), fixed.shape[1]))
        return pd.DataFrame({"_step": mine["_step"], "block": mine["block"], "cosines": list(_unit(rows) @ fixed.T)})

    keys = ["group", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, "_step long, block int, cosines array<double>")


def _cosines(matrix, width: int | None):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def cosines(series: pd.Series) -> pd.Series:
        rows = _dense(series, width)
        if rows.shape[1] != matrix.value.shape[0]:  # a batch of missing vectors only
            rows = np.zeros((len(rows), matrix.value.shape[0]))
        return pd.Series(list(_unit(rows) @ matrix.value))

    return cosines


def relative_timeline(conversations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Relative steps of both modalities as one table."""
    keep = [EVENT, "event_number", "conversation_ind", "relative"]
    talk = conversations.withColumn("conversation_ind", F.lit(1)).select(*keep, "conversation_id")
    clicks = sessions.withColumn("conversation_ind", F.lit(0)).select(*keep, "session_id")
    return talk.unionByName(clicks, allowMissingColumns=True)


# ---- means of the cosines of an event's steps


def unit_anchors(anchors: DataFrame, width: int | None = None) -> np.ndarray:
    """Anchors (``anchor_pos``, ``vector``) as the rows of one matrix, each of length 1 or zero."""
    return _unit(_dense(anchors.orderBy("anchor_pos").toPandas()["vector"], width))


@dataclass(frozen=True)
class Modality:
    """Steps of one modality as filled places: ``steps(event, entries, scale)``, ``scale`` being one over a step's
    length, 0 for a zero step. A row of ``weights`` is what a place adds to the products with the anchors,
    ``shift`` what every step adds."""

    steps: DataFrame
    weights: np.ndarray
    shift: np.ndarray
    indicator: int


def mean_cosines(modalities: Sequence[Modality]) -> DataFrame:
    """Of each event ``mean``: the mean over its steps of their cosines with the anchors, the indicator last.

    A cosine is linear in the step once that is divided by its length. So the steps are summed by event and
    place, with a combine before the shuffle, and meet the anchors once for each event; no step is
    written with its cosines. An event holds at most one sum for each place, whatever its number of steps.
    """
    tables, rows, at = [], [], 0
    for m in modalities:
        n = len(m.weights)
        scaled = F.transform("entries", lambda e: F.struct((e["at"] + at).alias("at"), (e["x"] * F.col("scale")).alias("x")))  # noqa: B023
        whole = [F.struct(F.lit(at + n).alias("at"), F.col("scale").alias("x")), F.struct(F.lit(at + n + 1).alias("at"), F.lit(1.0).alias("x"))]
        filled = F.when(F.col("scale") > 0, scaled).otherwise(F.array().cast("array<struct<at:int,x:double>>"))
        tables.append(m.steps.select(EVENT, F.explode(F.concat(filled, F.array(*whole))).alias("_e")))
        own = np.zeros((n + 2, m.weights.shape[1] + 2))  # the last two columns: the indicator, the number of steps
        own[:n, :-2], own[n, :-2], own[n + 1, -2:] = m.weights, m.shift, (m.indicator, 1)
        rows.append(own)
        at += n + 2
    placed = reduce(DataFrame.unionByName, tables).select(EVENT, "_e.at", "_e.x").groupBy(EVENT, "at").agg(F.sum("x").alias("x"))
    sums = placed.groupBy(EVENT).agg(F.collect_list(F.struct("at", "x")).alias("_e")).select(EVENT, F.col("_e.at").alias("at"), F.col("_e.x").alias("x"))
    matrix = sums.sparkSession.sparkContext.broadcast(np.concatenate(rows))
    schema = pa.schema([(EVENT, pa.int64()), ("mean", pa.list_(pa.float64()))])

    def multiply(batches):
        for batch in batches:
            ids, places = batch.column(EVENT), batch.column("at")
            counts = np.asarray(places.value_lengths(), dtype=np.int64)
            held = Rows(counts, np.asarray(places.flatten()), np.asarray(batch.column("x").flatten()), len(matrix.value))
            for start, stop, found in products(held, matrix.value):
                found = found[:, :-1] / found[:, -1:]
                ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                means = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), means], schema=schema)

    return sums.mapInArrow(multiply, f"{EVENT} long, mean array<double>")
