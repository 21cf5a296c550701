"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Rows of numbers that a task is worth.
EACH = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where that is unset and all tasks run on this machine (tests), a new
    one that is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read of the written table, and values that depend on how rows
    were dealt (row numbers, sampled ranges) are fixed from then on.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, each: int = EACH) -> DataFrame:
    """``df`` in no more partitions than ``rows``, which it is made of, have lots of ``each``.

    A shuffle has as many tasks and files for a thousand rows as for a billion, unless Spark is left to bring them together.
    """
    return df.coalesce(max(1, -(-rows // each)))


def write_counted(df: DataFrame, path: str, **metrics: Column) -> dict[str, Any]:
    """Write ``df`` as Parquet and return aggregates of its rows that are collected with the write, in the same pass."""
    seen = Observation(uuid.uuid4().hex)
    named = [v.alias(k) for k, v in metrics.items()]
    df.observe(seen, *named).write.parquet(path)
    return seen.get


def stage_counted(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict[str, Any]]:
    """As ``stage``, with aggregates of the rows from the same pass."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    found = write_counted(df, path, **metrics)
    return spark.read.schema(df.schema).parquet(path), found
