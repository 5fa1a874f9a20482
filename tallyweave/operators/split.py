"""Time-ordered holdout and validation tail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import half_even_share
from tallyweave.functions.positions import id_bucket, with_positions, with_running_sum
from tallyweave.schemas import EVENT


def holdout(timeline: DataFrame, test: bool = False, fraction: float = 0.9, by: str = "id") -> DataFrame:
    """Train rows (or test rows) of the timeline.

    ``by='id'`` compares the event id with the rounded share of the number of events: right for the
    dense, 0-based, time-ordered ids the tables promise, and pushed down to the scan. ``by='rank'``
    compares the rank of the id instead, for ids with gaps.
    """
    if by == "id":
        cut = timeline.agg(half_even_share(F.count_distinct(EVENT), fraction)).scalar()
        return timeline.where(F.col(EVENT) >= cut if test else F.col(EVENT) < cut)
    if by != "rank":
        raise ValueError("by must be 'id' or 'rank'")
    events = timeline.select(EVENT).distinct()
    ranked = with_positions(events, [], id_bucket(EVENT), [EVENT], "_rank", total="_total")
    cut = half_even_share(F.col("_total"), fraction)
    chosen = ranked.where(F.col("_rank") > cut if test else F.col("_rank") <= cut)
    return timeline.join(chosen.select(EVENT), EVENT, "left_semi")


def validation_split(
    rows: DataFrame, tail: float = 0.1, order: Sequence[str] = (EVENT,), name: str = "is_validation"
) -> DataFrame:
    """Mark the last ``ceil(tail * n)`` rows in event order.

    ``order`` starts with the event id and must be unique over the rows; later columns order the
    rows of one event, the second being a whole number. A row's rank is the number of rows of earlier
    events and its place in its own event, which is numbered in blocks of that second column, so no
    task holds all rows of a hot event. No row count, id or row passes through the driver.
    """
    if len(order) == 1:
        ranked = with_positions(rows, [], id_bucket(order[0]), list(order), "_rank", total="_total")
    else:
        event, number = order[0], F.coalesce(F.col(order[1]), F.lit(-2_147_483_648))
        counts = rows.groupBy(event).agg(F.count(F.lit(1)).alias("_n"))
        before = with_running_sum(counts, [], id_bucket(event), [event], F.col("_n"), "_before").drop("_n")
        inside = with_positions(rows, [event], F.floor(number / F.lit(4096)).cast("long"), list(order[1:]), "_inside")
        total = rows.agg(F.count(F.lit(1))).scalar()
        ranked = inside.join(before, event).select(
            *rows.columns, (F.col("_before") + F.col("_inside")).alias("_rank"), total.alias("_total")
        )
    # sizes are products of a count and a decimal share: take the ceiling of the same double product
    held = F.ceil(F.col("_total") * F.lit(float(tail)))
    return ranked.withColumn(name, F.col("_rank") > F.col("_total") - held).drop("_rank", "_total")
