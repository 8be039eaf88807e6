"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CREATED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a temporary folder only where none is set and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomdex-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_table(df: DataFrame, name: str, *, cluster_by: list[str] | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends here, executors may be lost.

    Parquet keeps later column pruning and statistics, which an RDD checkpoint would not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    df.write.parquet(path)
    _CREATED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove shared tables that nothing reads any more."""
    for table in tables:
        held = [x for x in _CREATED if x[1] == getattr(table, "shared_path", None)]
        for spark, path in held:
            _remove(spark, path)
            _CREATED.remove((spark, path))


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if it holds at most `rows` rows, else as it is; `df` should be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def drop_shared_tables() -> None:
    """Remove the tables this process wrote (also runs when it ends)."""
    while _CREATED:
        spark, path = _CREATED.pop()
        try:
            _remove(spark, path)
        except Exception as e:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():  # else the session is gone
                logging.getLogger(__name__).warning("%s stays: %s", path, e)


atexit.register(drop_shared_tables)
