"""Fitted state and staged tables, kept as parquet in a folder that every executor sees.

Nothing here depends on the life of one executor: a lost executor costs recomputation of its
tasks, never the table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a new folder where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tallyweave-")
    return _LOCAL_FOLDERS[app]


def stage(df: DataFrame, label: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back: cuts lineage, keeps column pruning."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Remove what this application has staged. Tables read from there are gone; call it at the end."""
    folder = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save_state(df: DataFrame, path: str) -> None:
    """Store fitted state (vocabulary, imputer statistics, popularity, anchors) as a table."""
    df.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
