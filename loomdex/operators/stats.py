"""Statistics of indexing runs and of the collection."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The order in which timings are shown; others follow by name.
TIMING_ORDER = ("scan", "size_check", "read", "hash", "manifest_check", "chunk", "embed", "build_points", "upsert", "manifest_write", "delete_old", "total")


def index_statistics(files: DataFrame) -> DataFrame:
    """One row: files by outcome, bytes in MiB, chunks in all, mean and most of indexed files. files: outcome, size_bytes, chunk_count."""
    of = lambda name: F.coalesce(F.count_if(F.col("outcome") == name), F.lit(0)).alias(name)
    chunks = F.when(F.col("outcome") == "indexed", F.col("chunk_count"))
    return files.agg(
        F.count("*").alias("scanned"), *[of(n) for n in ("indexed", "skipped", "empty", "too_large", "failed")],
        F.round(F.coalesce(F.sum("size_bytes"), F.lit(0)) / 1048576.0, 6).alias("mib"), F.coalesce(F.sum(chunks), F.lit(0)).alias("chunks"),
        F.round(F.coalesce(F.avg(chunks), F.lit(0.0)), 6).alias("average_chunks"), F.coalesce(F.max(chunks), F.lit(0)).alias("most_chunks"),
    )


class Timings:
    """Seconds by bucket, on the driver: what a run spent where, as (bucket, seconds) events for `stage_timings`."""

    def __init__(self) -> None:
        self.events: list[tuple[str, float]] = []

    @contextmanager
    def of(self, bucket: str) -> Iterator[None]:
        """Time what runs within, also where it fails."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.events.append((bucket, time.perf_counter() - began))

    def table(self, spark: SparkSession) -> DataFrame:
        return stage_timings(spark.createDataFrame(self.events, "bucket string, seconds double"))


def stage_timings(events: DataFrame) -> DataFrame:
    """bucket, seconds, position: times summed by bucket, in the order of TIMING_ORDER."""
    place = F.array_position(F.array(*[F.lit(x) for x in TIMING_ORDER]), F.col("bucket"))
    summed = events.groupBy("bucket").agg(F.sum("seconds").alias("seconds"))
    return summed.withColumn("position", F.when(place > 0, place).otherwise(F.lit(len(TIMING_ORDER) + 1)).cast("int"))


def collection_statistics(chunks: DataFrame) -> DataFrame:
    """source_name, chunks, files, languages: of distinct chunk ids."""
    return chunks.groupBy("source_name").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("path").alias("files"), F.countDistinct(F.lower(F.trim("language"))).alias("languages"))
