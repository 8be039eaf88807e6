"""Intervals on lines: merging, gaps, containment, nearest before."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: unions of ranges that overlap or touch (start <= last end + 1). Ranges with NULL or end < start are left out."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.where("start is not null and end >= start").withColumn("new", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def gaps(ranges: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: what the ranges leave of 1..total; a key without ranges leaves it all."""
    held = merge_ranges(ranges, keys).select(*keys, "start", "end")
    edges = held.unionByName(totals.select(*keys, (F.col("total") + 1).alias("start"), (F.col("total") + 1).alias("end")))
    order = W.partitionBy(*keys).orderBy("start")
    out = edges.withColumn("from", F.coalesce(F.lag("end").over(order), F.lit(0)) + 1).withColumn("to", F.col("start") - 1)
    return out.join(totals, keys).where("from <= to and from <= total").select(*keys, F.col("from").alias("start"), F.least("to", "total").alias("end"))


def nearest_before(points: DataFrame, marks: DataFrame, keys: list[str], value: str) -> DataFrame:
    """points (keys, line, ...) with the `value` of the last mark (keys, line, position) whose line is not after; NULL for none.

    One sort of the union by key and line: no pair of a point and all its marks is made.
    """
    rest = [c for c in points.columns if c not in (*keys, "line")]
    p = points.select(*keys, "line", F.lit(1).alias("order"), F.lit(0).cast("long").alias("position"), F.struct(F.lit(1).alias("one"), *rest).alias("point"), F.lit(None).cast(marks.schema[value].dataType).alias(value))
    m = marks.select(*keys, "line", F.lit(0).alias("order"), F.col("position").cast("long").alias("position"), F.lit(None).cast(p.schema["point"].dataType).alias("point"), value)
    order = W.partitionBy(*keys).orderBy("line", "order", "position").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = p.unionByName(m).withColumn(value, F.last(value, ignorenulls=True).over(order)).where("point is not null")
    return out.select(*keys, "line", *[F.col(f"point.{c}").alias(c) for c in rest], value)


def contained(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """points joined to each range of their key that holds their line (hash join on the key, the range as residual)."""
    return points.join(ranges, keys).where(F.col("line").between(F.col("start"), F.col("end")))


def uncovered(ranges: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """As `gaps`, of one key without Spark: the runs of 1..total that no (start, end) covers."""
    depth = np.zeros(total + 3, dtype=np.int64)
    for start, end in ranges:
        depth[min(max(start, 1), total + 1)] += 1
        depth[min(max(end, start - 1), total) + 1] -= 1
    free = np.concatenate([[False], np.cumsum(depth)[1 : total + 1] == 0, [False]])
    edges = np.flatnonzero(free[1:] != free[:-1]) + 1
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
