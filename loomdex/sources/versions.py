"""Tables whose versions are published atomically, as a log of deltas.

A snapshot lists, for each table, segments in order: folders of rows, and folders of keys that remove the rows
of those keys from all earlier segments. A run writes what it adds and the keys it replaces into folders of its
own and then commits one small log entry, so it costs what changed, not what there is. Compaction is a run apart.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdex.sources.shared import small_side

SMALL_REMOVALS = 100_000  # removed keys that may be broadcast when a table is read


class PublishedMeanwhile(RuntimeError):
    """Another run has published the version that this one was to publish."""


class TableLog:
    """Snapshots of named tables under one root.

    Version n is in force once the entry `_log/<n>` exists. It is made by one operation that fails where the entry
    is there already: a hard link on a local file system, a rename without overwriting on HDFS. So of two writers
    that start from the same version one wins and the other is refused; a run that dies leaves folders that
    nothing reads, which `vacuum` removes. Object stores without such an operation need a lock of their own.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _entries(self) -> list[int]:
        if not self._fs.exists(self._path("_log")):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path("_log")))
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """0 where nothing has been published."""
        return max(self._entries(), default=0)

    def snapshot(self, version: int | None = None) -> dict[str, list[dict]]:
        n = self.version() if version is None else version
        if not n:
            return {}
        stream = self._fs.open(self._path(f"_log/{n}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def rows(self, rows: DataFrame, *partition_by: str) -> dict:
        """A segment of rows."""
        return {"rows": self._written(rows, *partition_by), "schema": rows.schema.jsonValue()}

    def removal(self, keys: DataFrame) -> dict:
        """A segment that removes, from the segments before it, the rows with any of these keys (NULLs equal each other)."""
        return {"gone": self._written(keys.distinct()), "keys": keys.columns}

    def _written(self, rows: DataFrame, *partition_by: str) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        (rows.write.partitionBy(*partition_by) if partition_by else rows.write).parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, snapshot: dict[str, list[dict]], expected: int | None = None) -> int:
        """Put a snapshot in force as the version after `expected` (the one in force if None); refused if that exists."""
        n = (self.version() if expected is None else expected) + 1
        entry, draft = self._path(f"_log/{n}"), self._path(f"_log/draft-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path("_log"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(snapshot), "utf-8"))
        out.close()
        try:
            if not self._made(draft, entry):
                raise PublishedMeanwhile(f"version {n} of {self.root} was published meanwhile, {n - 1} was expected")
        finally:
            self._fs.delete(draft, False)
        return n

    def _made(self, draft, entry) -> bool:
        if self._fs.getUri().getScheme() == "file":
            of = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            if self._fs.exists(entry):
                return False
            try:
                self._jvm.java.nio.file.Files.createLink(of(entry), of(draft))
            except Exception as e:
                if "FileAlreadyExistsException" in str(e):
                    return False
                raise
            return True
        return not self._fs.exists(entry) and self._fs.rename(draft, entry)

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The live rows of a table; None where it has none. Removed keys are few beside the rows and are broadcast if their count allows."""
        segments = self.snapshot(version).get(name, [])
        held = [(n, s) for n, s in enumerate(segments) if "rows" in s]
        if not held:
            return None
        gone = [(n, s) for n, s in enumerate(segments) if "gone" in s and any(m < n for m, _ in held)]
        union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        load = lambda s: self.spark.read.schema(StructType.fromJson(s["schema"])).parquet(f"{self.root}/{s['rows']}")
        if not gone:
            return union([load(s) for _, s in held])
        rows = union([load(s).withColumn("__segment", F.lit(n)) for n, s in held])
        for keys in dict.fromkeys(tuple(s["keys"]) for _, s in gone):
            removed = union([self.spark.read.parquet(f"{self.root}/{s['gone']}").select(*keys, F.lit(n).alias("__until")) for n, s in gone if tuple(s["keys"]) == keys])
            removed = removed.groupBy(*keys).agg(F.max("__until").alias("__until"))
            on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(removed[k]) for k in keys]) & (rows["__segment"] < removed["__until"])
            rows = rows.join(small_side(removed, SMALL_REMOVALS), on, "left_anti")
        return rows.drop("__segment")

    def compact(self, partition_by: dict[str, tuple[str, ...]] | None = None) -> int:
        """Rewrite every table of several segments as one; refused, like any run, if another published meanwhile."""
        n = self.version()
        old = self.snapshot(n)
        new = {name: [self.rows(self.read(name, n), *(partition_by or {}).get(name, ()))] if len(s) > 1 and any("rows" in x for x in s) else s for name, s in old.items()}
        return n if new == old else self.commit(new, n)

    def vacuum(self, keep: int = 2, older_than_seconds: int = 86_400) -> int:
        """Remove log entries but the last `keep` (one at least) and folders that none of these names; younger folders may be of a run still writing."""
        entries, keep = self._entries(), max(1, keep)
        for n in entries[:-keep]:
            self._fs.delete(self._path(f"_log/{n}"), False)
        named = {folder for n in entries[-keep:] for segments in self.snapshot(n).values() for s in segments for folder in re.findall(r"data/\w+", json.dumps(s))}
        if not self._fs.exists(self._path("data")):
            return 0
        now = self._jvm.java.lang.System.currentTimeMillis()
        old = [f.getPath() for f in self._fs.listStatus(self._path("data")) if f"data/{f.getPath().getName()}" not in named and now - f.getModificationTime() >= 1000 * older_than_seconds]
        for path in old:
            self._fs.delete(path, True)
        return len(old)


class VersionedTable:
    """A log of one table."""

    NAME = "table"

    def __init__(self, spark: SparkSession, root: str):
        self.log = TableLog(spark, root)

    def version(self) -> int:
        return self.log.version()

    def read(self, version: int | None = None) -> DataFrame | None:
        return self.log.read(self.NAME, version)

    def publish(self, rows: DataFrame, expected: int | None = None) -> int:
        """Put `rows` in force in place of all before; refused if the version in force is not `expected`."""
        expected = self.version() if expected is None else expected
        return self.log.commit({self.NAME: [self.log.rows(rows)]}, expected)

    def amend(self, rows: DataFrame, gone: DataFrame, expected: int) -> int:
        """Remove the rows with the keys of `gone`, add `rows`; only these are written."""
        held = self.log.snapshot(expected).get(self.NAME, [])
        return self.log.commit({self.NAME: [*held, self.log.removal(gone), self.log.rows(rows)]}, expected)

    def compact(self) -> int:
        return self.log.compact()
