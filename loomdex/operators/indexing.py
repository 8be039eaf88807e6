"""The index as a whole: build incrementally, publish, prune, read."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.operators import code, dense, lexical, manifest
from loomdex.operators.chunking import chunk_files
from loomdex.operators.search import Index
from loomdex.operators.stats import Timings
from loomdex.sources.shared import shared_table
from loomdex.sources.versions import TableLog

OF_FILES = ("manifest", "file_chunks", "chunks", "postings", "lengths", "vectors")  # their rows go with their files
TABLES = (*OF_FILES, "cache")
BUCKETS = 16  # folders of postings by the hash of the term, so that a search reads those of its terms
WRITERS = 4
PARTITIONS = {"chunks": ("source_name",), "postings": ("bucket",)}
EMPTY = {
    "manifest": "source_name string, path string, file_hash string, chunk_count int, indexed_at timestamp",
    "file_chunks": "source_name string, path string, chunk_id string, ordinal int",
    "chunks": f"chunk_id string, source_name string, source_type string, source string, area string, module string, language string, path string, rel_path string, ordinal int, start_line int, end_line int, text string, text_for_embedding string, content_hash string, {code.PAYLOAD}",
    "postings": "term string, id string, source_name string, path string, field int, tf int, positions array<int>, bucket int",
    "lengths": "id string, source_name string, path string, both int, embedded int",
    "vectors": "id string, source_name string, path string, model_name string, text_hash string, vector array<float>",
    "cache": "model_name string, text_hash string, dim int, vector array<float>",
}


class IndexStore:
    """The index's tables in one log, so that they change together: a run that dies leaves the last snapshot in force.

    A run adds the rows of the files it processed and removes by key what these files had; nothing else is
    written. Postings and vectors are kept by chunk id, so that a search computes neither.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, TableLog(spark, root)

    def version(self) -> int:
        return self.log.version()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The live rows; an empty table where nothing has been published."""
        found = self.log.read(name, version)
        return self.spark.createDataFrame([], EMPTY[name]) if found is None else found

    def tables(self) -> dict[str, DataFrame] | None:
        version = self.version()
        return {name: self.table(name, version) for name in TABLES} if version else None

    def change(self, expected: int, gone: DataFrame | None, added: Mapping[str, DataFrame]) -> int:
        """Remove the rows of the files in `gone` (source_name, path) from the tables of files, add rows, publish."""
        old = self.log.snapshot(expected)
        with ThreadPoolExecutor(WRITERS) as pool:  # the tables are independent jobs
            removal = [pool.submit(self.log.removal, gone.select(*manifest.KEYS))] if gone is not None and expected else []
            written = {name: [pool.submit(self.log.rows, rows, *PARTITIONS.get(name, ()))] for name, rows in added.items()}
            new = {name: [*old.get(name, []), *[s.result() for s in (*(removal if name in OF_FILES else []), *written.get(name, []))]] for name in TABLES}
        return self.log.commit(new, expected)

    def paths(self, source_name: str) -> DataFrame:
        """The indexed paths of a source, in order."""
        return self.table("manifest").where(F.col("source_name") == source_name).select("path").distinct().orderBy("path")

    def describe(self) -> DataFrame:
        """table, columns, segments: what the version in force consists of."""
        segments = self.log.snapshot()
        rows = [(name, self.table(name).columns, sum("rows" in s for s in segments.get(name, [])), sum("gone" in s for s in segments.get(name, []))) for name in TABLES]
        return self.spark.createDataFrame(rows, "table string, columns array<string>, segments int, removals int")

    def compact(self) -> int:
        return self.log.compact(PARTITIONS)


def bucket(term: str):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index_source(store: IndexStore, files: DataFrame, model: str, embed: Callable[[list[str]], np.ndarray], prefix: str = "passage: ", max_bytes: int | None = None, force: bool = False, dry_run: bool = False, source_type: str = "project", configs: dict | None = None, max_chunks_per_file: int | None = None, metadata: Mapping | None = None, stop_on_error: bool = False, timings: Timings | None = None, max_memory_mb: int | None = None) -> DataFrame:
    """Index new and changed files; the files with their outcomes (and `fault`, the reason, of those that failed).

    Files grown too large lose their chunks. A file that fails keeps the state it had and stops no other, unless
    `stop_on_error`. `metadata`: source, area and module of the source for the chunks' payload. `timings` takes the
    seconds of the run's steps; a Python worker that holds more than `max_memory_mb` ends the run.
    """
    timings = timings or Timings()
    expected = store.version()
    with timings.of("manifest_check"):
        judged = shared_table(manifest.outcomes(files, store.table("manifest", expected), max_bytes, force, dry_run), "outcomes")
    if dry_run:
        return judged.withColumn("fault", F.lit(None).cast("string"))
    keys = manifest.KEYS
    with timings.of("chunk"):
        cut = shared_table(chunk_files(judged.where("outcome = 'indexed'"), configs, max_chunks_per_file, faults=True, max_memory_mb=max_memory_mb), "new-chunks")
    failed = cut.where("fault is not null").groupBy(*keys).agg(F.min("fault").alias("fault"))
    judged = judged.join(failed, keys, "left").withColumn("outcome", F.when(F.col("fault").isNotNull(), "failed").otherwise(F.col("outcome")))
    if stop_on_error and not failed.isEmpty():
        raise RuntimeError(f"{failed.count()} files failed: {failed.head()['fault']}")
    todo = judged.where("outcome in ('indexed', 'empty', 'too_large')").select(*keys, "outcome", "file_hash")
    told = metadata or {}
    new = cut.where("fault is null").drop("fault").withColumnRenamed("chunk", "text").withColumn("source_type", F.lit(source_type)).withColumn("source", F.coalesce(F.lit(told.get("source")), "source_name"))
    new = new.withColumn("area", F.lit(told.get("area")).cast("string")).withColumn("module", F.lit(told.get("module")).cast("string"))
    with timings.of("embed"):
        embedded, made = dense.embed_cached(new.select(F.col("chunk_id").alias("id"), *keys, F.col("text_for_embedding").alias("text")), store.table("cache", expected), model, embed, prefix, max_memory_mb)
    entries, links, _ = manifest.replace_files(*(store.spark.createDataFrame([], EMPTY[name]) for name in ("manifest", "file_chunks")), new.limit(0), todo.where("outcome != 'too_large'"), new)
    tokens = shared_table(lexical.tokenised(new.withColumnRenamed("chunk_id", "id"), ["id", *keys], [F.col("text"), F.col("text_for_embedding")]), "new-tokens")
    postings = lexical.grouped(lexical.placed(tokens, ["id", *keys]).withColumn("field", F.floor(F.col("pos") / lexical.FIELD_GAP).cast("int"))).withColumn("bucket", bucket("term"))
    lengths = tokens.select("id", *keys, F.size(F.get("terms", F.lit(0))).alias("text"), F.size(F.get("terms", F.lit(1))).alias("embedded"))
    added = {
        "manifest": entries, "file_chunks": links, "chunks": new, "cache": made,
        "postings": postings.repartition("bucket").sortWithinPartitions("bucket", "term"),
        "lengths": lengths.select("id", *keys, (F.col("text") + F.col("embedded")).alias("both"), "embedded"),
        "vectors": embedded.select("id", *keys, F.lit(model).alias("model_name"), "text_hash", "vector"),
    }
    with timings.of("upsert"):
        if not todo.isEmpty():
            store.change(expected, todo, {name: rows.select(*code.names_of(EMPTY[name])) for name, rows in added.items()})
    return judged


def prune(store: IndexStore, files: DataFrame, dry_run: bool = False) -> DataFrame:
    """Remove what belongs to files that are gone; the report of `manifest.prune_report`."""
    expected = store.version()
    entries = store.table("manifest", expected)
    report = shared_table(manifest.prune_report(entries, store.table("file_chunks", expected), files), "pruned")
    if not dry_run:
        gone = shared_table(manifest.stale(entries, files).select(*manifest.KEYS), "stale")
        if not gone.isEmpty():
            store.change(expected, gone, {})
    return report


class StoredIndex(lexical.LexicalIndex):
    """Postings from the store: a search reads the buckets of its terms only."""

    def of_terms(self, terms: DataFrame) -> DataFrame:
        asked = [r["bucket"] for r in terms.select(bucket("term").alias("bucket")).distinct().collect()]  # BUCKETS numbers at most
        held = StoredIndex(None, self.lengths, self.statistics, self.stored.where(F.col("bucket").isin(asked)))
        return lexical.LexicalIndex.of_terms(held, terms).groupBy("term", "id").agg(F.sum("tf").cast("int").alias("tf"), F.flatten(F.collect_list("positions")).alias("positions"))


def stored_index(postings: DataFrame, lengths: DataFrame, length: str) -> StoredIndex:
    sized = lengths.select("id", F.col(length).alias("length"))
    return StoredIndex(None, sized, sized.agg(F.count("*").alias("n"), F.avg("length").alias("average")), postings)


def open_index(store: IndexStore, model: str, embed: Callable[[list[str]], np.ndarray], prefix: str = "passage: ", query_prefix: str = "query: ") -> Index:
    """The index in force. A model of which it holds vectors of another length than `embed` makes is refused."""
    version = store.version()
    chunks, vectors, postings, lengths = (store.table(name, version) for name in ("chunks", "vectors", "postings", "lengths"))
    vectors = vectors.where(F.col("model_name") == model)
    first = vectors.select(F.size("vector").alias("n")).head()
    if first and first["n"] != dense.vector_size(embed):
        raise ValueError(f"the index holds vectors of {first['n']} numbers for {model}, the embedder makes {dense.vector_size(embed)}")
    index = Index(chunks, vectors.select("id", "vector"), embed, query_prefix)
    index._built |= {"lexical": stored_index(postings, lengths, "both"), "sparse": stored_index(postings.where("field = 1"), lengths, "embedded")}
    return index
