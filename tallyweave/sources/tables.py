"""Readers and writers of the six input tables."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave import schemas


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """One CSV file, a folder of shards or a list of them, read as one table by the names in their headers.

    Each file may hold the columns in an order of its own and further columns; a column that a file
    lacks raises. Quotes inside a quoted value are doubled. Whole numbers may be written as floats
    (``12.0``, ``1e3``); an empty value is null, and any other text in a number column raises. The headers
    of all files are found by one job; files with the same header are read together.
    """
    parts = [_by_name(spark, header, files, schema) for header, files in headers(spark, path)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def headers(spark: SparkSession, path: str | list[str]) -> list[tuple[tuple[str, ...], list[str]]]:
    """Each different header with its files. Tasks look for the first line of each file; a row for each
    different header, with the names of its files, comes to the driver, whatever the number of files."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start"))
    placed = lines.where("start = 0 and trim(value) <> ''").withColumn("place", F.monotonically_increasing_id())
    first = placed.groupBy("file_path").agg(F.min_by("value", "place").alias("header"))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("files")).collect()
    return [(tuple(next(csv.reader([row["header"]]))), [unquote(f) for f in row["files"]]) for row in sorted(found, key=lambda row: row["header"])]


def _reader(spark: SparkSession) -> DataFrameReader:
    return spark.read.options(header=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False)


def _by_name(spark: SparkSession, header: tuple[str, ...], files: list[str], schema: T.StructType) -> DataFrame:
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{files[0]} has no column {', '.join(missing)}")
    # fractions are left to the parser; ids and counts come as text, to be read exactly
    kinds = {f.name: f.dataType for f in schema.fields if isinstance(f.dataType, T.FractionalType)}
    raw = T.StructType([T.StructField(name, kinds.get(name, T.StringType())) for name in header])
    rows = _reader(spark).schema(raw).csv(files)
    return rows.select(*[_whole(f.name, f.dataType) if isinstance(f.dataType, T.IntegralType) else F.col(f.name) for f in schema.fields])


def _whole(name: str, kind: T.DataType) -> Column:
    """The column's text as a whole number; a text that is none raises when the row is read."""
    text = F.trim(F.col(name))
    exact = text.try_cast("decimal(38,10)")
    value = F.when(exact == F.floor(exact), F.floor(exact)).try_cast(kind)
    wrong = F.raise_error(F.concat(F.lit(f"{name} is no {kind.simpleString()}: "), text)).cast(kind)
    return F.when(text != "", F.coalesce(value, wrong)).alias(name)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """The timeline."""
    return read_csv(spark, path, schemas.USERS)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.SESSIONS)


def read_conversations_keyword(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CONVERSATIONS_KEYWORD)


def read_conversations_embedding(spark: SparkSession, path: str | list[str], width: int = 768) -> DataFrame:
    """All shards in one read, packed to one array column so later stages stay narrow."""
    return pack_embedding(read_csv(spark, path, schemas.wide_embedding(width)), width)


def read_purchase_events(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PURCHASE_EVENTS)


def read_post_filter(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.POST_FILTER)


def pack_embedding(wide: DataFrame, width: int, prefix: str = "embedding_") -> DataFrame:
    """``embedding_1..n`` columns to one ``ARRAY<FLOAT>``; NaN becomes NULL."""
    values = [F.nanvl(F.col(f"{prefix}{i}"), F.lit(None).cast("float")) for i in range(1, width + 1)]
    names = [f"{prefix}{i}" for i in range(1, width + 1)]
    keys = [c for c in wide.columns if c not in set(names)]
    return wide.select(*keys, F.array(*values).cast("array<float>").alias("embedding"))


def write_clustered(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Convert once: a bucketed, sorted parquet table lets every later join on ``key`` skip its shuffle."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
