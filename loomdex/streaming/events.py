"""Streams: incremental indexing by micro-batches, and windows over events (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdex.operators.indexing import IndexStore, index_source


COMPACT_AFTER = 50


def stream_files(spark: SparkSession, folder: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_trigger: int = 64) -> StreamingQuery:
    """Hand new Parquet files of a folder to `handle(batch, batch_id)`, each exactly once if it is idempotent by batch id.

    The source reports no deletions: prune by a full scan from time to time.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_index(spark: SparkSession, folder: str, store: IndexStore, model: str, embed: Callable, checkpoint: str, files_per_trigger: int = 64) -> StreamingQuery:
    """Index Parquet files of the shape of `sources.files` as they arrive. A batch that is repeated after a failure finds its files unchanged.

    Each batch adds a segment to the index's tables; every COMPACT_AFTER of them are joined.
    """
    schema = "source_name string, path string, rel_path string, language string, size_bytes bigint, text string"

    def handle(batch: DataFrame, number: int) -> None:
        index_source(store, batch, model, embed)
        if number % COMPACT_AFTER == COMPACT_AFTER - 1:
            store.compact()

    return stream_files(spark, folder, schema, checkpoint, handle, files_per_trigger)


def with_event_time(events: DataFrame) -> DataFrame:
    """`ts` as a timestamp with zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", lateness: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", lateness) if lateness else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    out = events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("window_start"), "events", "users")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "events")
