"""Incremental ingest and latest-state tables with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from millrace.operators.runs import insert_if_absent
from millrace.streaming.closing import Closing


def stored(spark: SparkSession, path: str, kind: StructType) -> DataFrame:
    """What ``ingest`` has inserted below ``path`` so far."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, sequence: str = "sequence", closing: Closing | None = None) -> StreamingQuery:
    """Insert each micro-batch's new postings (by url and by id) below ``path``, in a folder named by the batch.

    A batch that is run again after a failure overwrites its own folder, and is held against earlier ones only: so it
    inserts what it would have inserted, nothing twice and nothing less. ``closing`` counts the rows that batches read and
    insert, in the pass that writes them, and may close the stream between two batches.
    """
    spark, kind, closing = stream.sparkSession, stream.schema, closing or Closing()

    def add(batch: DataFrame, number: int) -> dict[str, int]:
        held = stored(spark, path, StructType([*kind.fields, StructField("batch", LongType())])).filter(F.col("batch") < number)
        read, put = Observation(f"read {number}"), Observation(f"inserted {number}")
        rows = insert_if_absent(held, batch.observe(read, F.count(F.lit(1)).alias("read")), sequence)
        rows.observe(put, F.count(F.lit(1)).alias("inserted")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        return {**read.get, **put.get}

    spark.streams.addListener(closing)
    return closing.watch(stream.writeStream.foreachBatch(closing.guard(add)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_by_key(spark: SparkSession, path: str, key: str, at: str, tie: str, value: str, output: str, checkpoint: str) -> DataFrame:
    """The last value of each key in a folder of Parquet files, as (key, value, at): a streaming aggregate in update mode,
    whose batches are appended with their number; the newest state of each key is the result. Runs what is there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(folder).isDirectory():
        reader = reader.option("pathGlobFilter", folder.getName())  # a stream reads folders
        path = folder.getParent().toString()
    rows = reader.parquet(path)
    last = rows.groupBy(key).agg(F.max_by(F.struct(value, at), F.struct(at, tie)).alias("last"))

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={number}")

    query = last.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.parquet(output).groupBy(key).agg(F.max_by("last", "batch").alias("last"))
    return states.select(key, f"last.{value}", f"last.{at}")
