"""The manifest: what is indexed, what changed, what is stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["source_name", "path"]


def file_hash(text: str = "text"):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def outcomes(files: DataFrame, manifest: DataFrame, max_bytes: int | None = None, force: bool = False, dry_run: bool = False) -> DataFrame:
    """files with file_hash and outcome: too_large, scanned (dry run), skipped (unchanged), empty or indexed; in this order."""
    known = manifest.select(*KEYS, F.col("file_hash").alias("known_hash"))
    rows = files.withColumn("file_hash", file_hash()).join(known, KEYS, "left")
    large = F.col("size_bytes") > max_bytes if max_bytes is not None else F.lit(False)
    same = F.lit(False) if force else F.coalesce(F.col("known_hash") == F.col("file_hash"), F.lit(False))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    outcome = F.when(large, "too_large").when(F.lit(dry_run), "scanned").when(same, "skipped").when(blank, "empty").otherwise("indexed")
    return rows.withColumn("outcome", outcome).drop("known_hash")


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or have another hash; equal file hashes of the same key are unchanged."""
    known = manifest.select(*KEYS, "file_hash")
    return files.withColumn("file_hash", file_hash()).join(known, [*KEYS, "file_hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` in place of those of `old` with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_files(manifest: DataFrame, file_chunks: DataFrame, chunks: DataFrame, processed: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, file-to-chunk table and chunk table after `processed` files got `new_chunks`; ordinals count anew from 1.

    Files without chunks stay in the manifest with a count of 0. The three are published together by the caller.
    """
    counts = new_chunks.groupBy(*KEYS).agg(F.count("*").cast("int").alias("chunk_count"))
    entries = processed.select(*KEYS, "file_hash").join(counts, KEYS, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).withColumn("indexed_at", F.current_timestamp())
    nth = F.row_number().over(W.partitionBy(*KEYS).orderBy("ordinal", "chunk_id")).cast("int")
    links = new_chunks.select(*KEYS, "chunk_id", nth.alias("ordinal"))
    replaced = lambda table, rows: delete(table, processed, KEYS).unionByName(rows, allowMissingColumns=True)
    return upsert(manifest, entries, KEYS), replaced(file_chunks, links), replaced(chunks, new_chunks)


def stale(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows of the scanned sources whose path is no longer there."""
    scanned = files.select("source_name").distinct()
    return manifest.join(scanned, "source_name", "left_semi").join(files.select(*KEYS), KEYS, "left_anti")


def prune_report(manifest: DataFrame, file_chunks: DataFrame, files: DataFrame) -> DataFrame:
    """source_name, stale_files, stale_chunks: what pruning would remove; zeros for sources with nothing stale."""
    gone = stale(manifest, files).select(*KEYS).distinct()
    counted = gone.join(file_chunks.select(*KEYS, "chunk_id").distinct(), KEYS, "left").groupBy("source_name").agg(F.countDistinct("path").alias("stale_files"), F.count("chunk_id").alias("stale_chunks"))
    return files.select("source_name").distinct().join(counted, "source_name", "left").select("source_name", F.coalesce("stale_files", F.lit(0)).alias("stale_files"), F.coalesce("stale_chunks", F.lit(0)).alias("stale_chunks"))


def stale_chunk_ids(old_links: DataFrame, new_links: DataFrame) -> DataFrame:
    """Chunk ids that files had and no longer have."""
    return old_links.select(*KEYS, "chunk_id").distinct().join(new_links.select(*KEYS, "chunk_id"), [*KEYS, "chunk_id"], "left_anti")


def chunk_ids(links: DataFrame) -> DataFrame:
    """source_name, path, chunk_ids: in order of ordinal, then id."""
    return links.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_set(F.struct("ordinal", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))


def retrieve(points: DataFrame, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """Points of the asked ids (id, pos) with pos, to be ordered by it; unknown ids drop out."""
    return ids.join(points, id_column)
