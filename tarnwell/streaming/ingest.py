"""Incremental ingest and totals as streams that can be run again after a failure."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators.chunking import fixed_chunks, one_of_each_hash
from tarnwell.session import shared_dir


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet file or folder, with the schema of its files."""
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # on whatever storage it is
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    folder = path if status.isDirectory() else f"{os.path.dirname(path)}/*{os.path.basename(path)}"
    return spark.readStream.schema(schema).parquet(folder)


def run_to_end(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Write what is there and stop; a later run goes on where this one ended."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", target)
    writer.start().awaitTermination()


def hourly_totals(spark: SparkSession, path: str, late: str = "7 days") -> DataFrame:
    """``hour``, ``event_type``, ``n``, ``total`` of all events in the files.

    Each batch replaces the totals it changed; rows are written by hour and kind under the number
    of their batch, and the last of each holds, so a batch that is repeated changes nothing.
    """
    target = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = stream_of(spark, path).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    totals = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("hour"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    run_to_end(totals, f"{target}/rows", f"{target}/checkpoint", "update", write)
    rows = spark.read.parquet(f"{target}/rows")
    last = rows.groupBy("hour", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("t"))
    return last.select("hour", "event_type", "t.n", F.round("t.total", 4).alias("total"))


def chunk_new_documents(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Documents that arrived since the last run, cut into windows; contents already stored are left out."""

    def add(batch: DataFrame, number: int) -> None:
        new = one_of_each_hash(fixed_chunks(batch.dropDuplicates(["id"])))
        try:
            stored = spark.read.parquet(target).where(F.col("batch") != number).select("content_hash").distinct()
        except AnalysisException:  # nothing is stored yet
            stored = None
        if stored is not None:
            new = new.join(stored, "content_hash", "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_to_end(stream_of(spark, source), target, checkpoint, each=add)
