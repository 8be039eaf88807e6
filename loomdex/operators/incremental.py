"""Processing only new or changed records: the target is the state.

Every row of the target holds the key and version of the source record it was made from. A run takes the
source records that have no such row (an anti-join), makes their rows, and publishes the next version of
the target atomically. A failed run publishes nothing, so none of its records counts as done and none is
done twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.paths import canonical_hash, canonical_path
from loomdex.sources.shared import shared_table
from loomdex.sources.versions import VersionedTable


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """keys and the `value` of the greatest `order`; partial aggregation keeps a hot key to one row a task."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("value"))
    return rows.groupBy(*keys).agg(F.max(rank).alias("top")).select(*keys, F.col("top.value").alias(value))


def pending(source: DataFrame, target: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The rows of `source` whose (keys, version) no row of `target` has.

    NULL keys and versions equal each other. Rows of `source` equal in keys and version all come out;
    other columns of `target` are ignored, so their names may clash. An empty target leaves all of source.
    """
    done = target.select(*keys, version).distinct()
    on = [source[c].eqNullSafe(done[c]) for c in (*keys, version)]
    return source.join(done, on, "left_anti")


def run_incremental(
    source: DataFrame, target: VersionedTable, keys: Sequence[str], version: str, make: Callable[[DataFrame], DataFrame]
) -> int:
    """Make the rows of new and changed records, drop rows of those changed or gone, publish; the version in force after.

    Only the rows made and the keys dropped are written; `target.compact()` joins such deltas.

    `source` has one row per key. `make` returns rows that keep `keys` and `version`; a record for which it
    returns none gets a row of NULLs, so that the next run takes it as done. Without changes nothing is
    published.
    """
    before = target.version()
    old = target.read(before) if before else None
    marks = [*keys, version]
    todo = source if old is None else pending(source, old, keys, version)
    todo = shared_table(todo, "pending")
    gone = None if old is None else shared_table(pending(old.select(*marks).distinct(), source, keys, version).select(*keys), "gone")
    if before and todo.isEmpty() and gone.isEmpty():
        return before
    made = make(todo)
    left, right = todo.select(*marks), made.alias("made")
    on = [left[c].eqNullSafe(F.col(f"made.{c}")) for c in marks]
    rows = left.join(right, on, "left").select(*[left[c] for c in marks], *[F.col(f"made.{c}") for c in made.columns if c not in marks])
    return target.publish(rows, expected=before) if old is None else target.amend(rows, gone, before)


def files_to_process(indexed_files: DataFrame, index_runs: DataFrame, file_scan: DataFrame, run_id: int) -> DataFrame:
    """source_name, path, file_hash: what `run_id` has to process.

    State: the newest row of each file in indexed_files, by indexed_at, that a run with status ok for its
    source wrote; rows of failed, aborted and running runs count for nothing. Source: the last scan of
    `run_id` with a hash, by scanned_at, then scan_id. Paths and hashes are compared in one spelling. A NULL
    source or path names no file; NULL times are the oldest. A file without scan in the run does not come out.
    """
    ok = index_runs.where("lower(trim(status)) = 'ok'").select("run_id", "source_name").distinct()
    done = indexed_files.select("source_name", "path", "file_hash", "indexed_at", "run_id").join(ok, ["run_id", "source_name"], "left_semi")
    state = newest(spelled(done), ["source_name", "path"], [F.col("indexed_at")], "file_hash")
    seen = file_scan.where(F.col("run_id") == run_id).select("source_name", "path", "file_hash", "scanned_at", "scan_id")
    seen = spelled(seen).where("file_hash is not null")
    source = newest(seen, ["source_name", "path"], [F.col("scanned_at"), F.col("scan_id")], "file_hash")
    return pending(source, state, ["source_name", "path"], "file_hash")


def spelled(rows: DataFrame) -> DataFrame:
    rows = rows.where("source_name is not null and path is not null")
    return rows.withColumn("path", canonical_path(F.col("path"))).withColumn("file_hash", canonical_hash(F.col("file_hash")))
