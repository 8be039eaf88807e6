"""Reciprocal-rank fusion of any number of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 60


def fuse(legs: dict[str, DataFrame], keys: list[str] | None = None, k: int = K, limit: int | None = None) -> DataFrame:
    """keys, id, score, rank, and `<leg>_rank`, `<leg>_score` of each leg.

    A leg has `id`, `rank` (from 1), `score` and the query's `keys`. score = sum of 1 / (k + rank) over all
    appearances; of an id repeated in a leg the last rank stays. Equal scores rank by the first leg's rank,
    then the second's and so on, then by id. NULL and empty ids are skipped. One aggregation, no join of legs.
    """
    keys = keys or []
    parts = []
    for name, leg in legs.items():
        row = leg.where("id is not null and cast(id as string) != ''")
        parts.append(row.select(*keys, "id", F.lit(name).alias("leg"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score")))
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    columns = []
    for name in legs:
        of = F.when(F.col("leg") == name, F.struct("rank", "score"))
        columns += [F.max(of)["rank"].alias(f"{name}_rank"), F.max(of)["score"].alias(f"{name}_score")]
    fused = everything.groupBy(*keys, "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), *columns)
    order = [F.desc(F.round("score", 12)), *[F.asc_nulls_last(f"{name}_rank") for name in legs], F.asc("id")]
    if not keys:  # one query: its lists are as long as their legs' limits
        best = fused if limit is None else fused.orderBy(*order).limit(limit)
        return best.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    ranked = fused.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
