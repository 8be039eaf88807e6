"""Files as tables: from folders, or from any table of paths and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.text import glob_regex, ignored, language_of, relative_path


def spread(rows: DataFrame) -> DataFrame:
    """`rows`, a scan, in as many partitions as there are cores where its files give fewer, so that work row by row uses them all; others stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores else rows.repartition(cores)


def included(rel_path, patterns: list[str]):
    """Whether any include glob fits; `**/*` fits all."""
    if not patterns or "**/*" in patterns or "**" in patterns:
        return F.lit(True)
    out = F.lit(False)
    for p in patterns:
        out = out | rel_path.rlike(glob_regex("/" + p.lstrip("/")).removesuffix("(?:/|$)") + "$")
    return out


def scan_folder(spark: SparkSession, name: str, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_files: int | None = None, with_text: bool = True) -> DataFrame:
    """source_name, path, rel_path, language, size_bytes[, text]: the regular files below `root`, sorted by path where `max_files` is set.

    Includes are globs from the root, excludes ignore-file patterns. Bytes that are no UTF-8 become U+FFFD.
    Without text the contents are not read. Spark's file source leaves out files of no bytes: they count as
    gone, so pruning clears them; a file of blanks is an empty one.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    rel = relative_path(F.col("path"), root.removeprefix("file://"))
    out = raw.withColumn("path", path).withColumn("rel_path", rel)
    out = out.where(included(F.col("rel_path"), include or []) & ~ignored(F.col("rel_path"), exclude or []))
    columns = [F.lit(name).alias("source_name"), "path", "rel_path", language_of(F.col("path")).alias("language"), F.col("length").alias("size_bytes")]
    if with_text:
        columns.append(F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return first_files(out.select(*columns).dropDuplicates(["source_name", "path"]), max_files)


def first_files(files: DataFrame, most: int | None) -> DataFrame:
    """The first files by path, all of them where `most` is None."""
    return files if most is None else files.orderBy("path", "source_name").limit(most)


def from_table(rows: DataFrame, source: str, path: str, text: str, root: str = "") -> DataFrame:
    """The same shape from a table; size is that of the UTF-8 text."""
    rel = relative_path(F.col(path), root) if root else F.col(path)
    return rows.select(
        F.col(source).alias("source_name"), F.col(path).alias("path"), rel.alias("rel_path"), language_of(F.col(path)).alias("language"), F.octet_length(text).cast("long").alias("size_bytes"), F.col(text).alias("text")
    )


def within_size(files: DataFrame, max_bytes: int) -> DataFrame:
    return files.where(F.col("size_bytes") <= max_bytes)
