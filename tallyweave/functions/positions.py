"""Row positions that survive a group of any size.

``row_number`` over a group sorts the whole group in one task. Here the group is cut into buckets
by a value that grows with the wanted order; rows are numbered inside their bucket and shifted by
the number of rows in the earlier buckets. Only bucket *counts* meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.state import stage

BUCKET_WIDTH = 65_536


def id_bucket(column: str, width: int = BUCKET_WIDTH) -> Column:
    """Bucket of a dense integer id."""
    return F.floor(F.col(column) / F.lit(width)).cast("long")


def hash_bucket(column: Column, bits: int = 16) -> Column:
    """Bucket of a 64-bit hash: its leading bits, which keep the signed order of the hash."""
    return F.shiftright(column, 64 - bits)


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    name: str,
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row inside its group.

    ``bucket`` must be non-null and non-decreasing in ``order``. ``total`` also adds the group size.
    """
    rows = df.withColumn("_bucket", bucket)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if total:
        shifts = shifts.withColumn(total, F.sum("_n").over(group))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.join(shifts.drop("_n"), [*keys, "_bucket"])
        .withColumn(name, F.row_number().over(inside) + F.col("_shift"))
        .drop("_bucket", "_shift")
    )


def with_running_sum(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str], value: Column, name: str
) -> DataFrame:
    """Add the sum of ``value`` over all strictly earlier rows of the group."""
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_s"))
    shifts = sums.withColumn("_shift", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(shifts, [*keys, "_bucket"])
        .withColumn(name, F.coalesce(F.sum("_value").over(inside), F.lit(0)) + F.col("_shift"))
        .drop("_bucket", "_value", "_shift")
    )


def range_positions(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with the 1-based position of ``column`` (not null, each value once), for values of any kind.

    Spark cuts the rows into ranges of about equal size; rows and ranges are written once, so that the
    counts of the ranges and the numbers inside them see the same cut.
    """
    ranges = stage(df.repartitionByRange(column).withColumn("_bucket", F.spark_partition_id()), f"ranges-{name}")
    return stage(with_positions(ranges.withColumnRenamed("_bucket", "_range"), [], F.col("_range"), [column], name).drop("_range"), name)
