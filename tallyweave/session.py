"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution on and a fixed time zone.

    On a cluster leave ``shuffle_partitions`` unset and size it there: adaptive execution merges
    small shuffle partitions, so a generous number costs little.
    """
    builder = (
        SparkSession.builder.appName("tallyweave")
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
