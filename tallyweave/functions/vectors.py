"""Sparse ML vectors from ``(at, x)`` entries, without leaving the JVM.

An ML vector is stored in parquet as a struct of its size, places and values. Feature tables are
stored anyway, so the struct is written as such and read back as a vector.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.state import stage


def dense_entries(vector: Column, offset: int = 0) -> Column:
    return F.transform(
        vector, lambda x, i: F.struct((i + offset).cast("int").alias("at"), x.cast("double").alias("x"))
    )


ENTRIES = "array<struct<at:int,x:double>>"


def shifted(entries: Column, offset: int) -> Column:
    held = F.coalesce(entries.cast(ENTRIES), F.array().cast(ENTRIES))
    if not offset:
        return held
    return F.transform(held, lambda e: F.struct((e["at"] + offset).cast("int").alias("at"), e["x"].alias("x")))


def entry(value: Column, at: int) -> Column:
    """One entry as an array, to be joined to others."""
    return F.array(F.struct(F.lit(at).alias("at"), value.cast("double").alias("x")))


def stage_vectors(rows: DataFrame, size: int, label: str) -> DataFrame:
    """Write ``rows`` with their ``entries`` (sorted by place) and read them back with a ``vector``."""
    stored = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.col("_filled.at").alias("indices"),
        F.col("_filled.x").alias("values"),
    )
    keys = [c for c in rows.columns if c != "entries"]
    # a column of its own, so that entries are made and filtered once for places and values
    filled = rows.select(*keys, F.filter(shifted(F.col("entries"), 0), lambda e: e["x"] != 0).alias("_filled"))
    written = filled.select(*keys, stored.alias("vector"))
    schema = T.StructType([*written.schema.fields[:-1], T.StructField("vector", VectorUDT())])
    return stage(written, label, schema)
