"""Lineage cuts on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary one; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp("shared")
    return base


def durable(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, written to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base_folder(df.sparkSession))
    return df.checkpoint()


#: Rows that a task gets of what ``spread`` deals out.
ROWS = 200_000


def spread(df: DataFrame, *keys: Column | str, parts: int | None = None) -> DataFrame:
    """The rows dealt by keys to as many partitions as give each about ROWS of them, so that tasks don't grow with the input.

    AQE merges no partitions whose number is given; joins and groupings by the keys, or more, deal nothing anew.
    """
    return df.repartition(parts or parts_of(df), *keys)


def parts_of(df: DataFrame) -> int:
    """How many partitions ``spread`` deals these rows to."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables where all executors see it."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"
