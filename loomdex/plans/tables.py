"""Reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdex.sources.files import spread

TEXTS = ("chunk_fts", "documents", "raw_files", "dense_embedding_cache")  # tables whose rows are worked on one by one


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows
