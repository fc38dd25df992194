"""Streams: chunked ingest, re-ranking per batch, patch logs.

Watermarked per-user windows are an addition of this library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators.review import coalesce_patches


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int = 100) -> StreamingQuery:
    """Append new Parquet files of a folder to a table, a bounded number per batch, until none is left."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return prepare(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rerank_each_batch(stream: DataFrame, main: DataFrame, match: Callable[[DataFrame, DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Match every batch of incoming records against the main table and write its result by batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        match(main, batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_patches(patches: DataFrame, id_col: str = "record_id", order: str = "ord") -> DataFrame:
    """The patch log of a batch, one row per record that changed."""
    return coalesce_patches(patches, id_col, order)


def user_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums per user type and window, late rows up to ``late`` included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
