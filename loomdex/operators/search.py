"""Search: five modes over the tables of an index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions.text import truncated
from loomdex.operators import dense, fusion, lexical
from loomdex.operators.filters import Scope

MODES = ("dense", "lexical", "sparse", "hybrid", "hybrid-fused")


@dataclass
class Index:
    """chunks: one row per chunk_id; vectors: id, vector; lexical over text and text_for_embedding, sparse over text_for_embedding."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    embed: Callable[[list[str]], np.ndarray] | None = None
    query_prefix: str = "query: "
    _built: dict = field(default_factory=dict)

    def lexical(self) -> lexical.LexicalIndex:
        if "lexical" not in self._built:
            self._built["lexical"] = lexical.build_index(self.chunks, "chunk_id", ["text", "text_for_embedding"])
        return self._built["lexical"]

    def sparse(self) -> lexical.LexicalIndex:
        if "sparse" not in self._built:
            self._built["sparse"] = lexical.build_index(self.chunks, "chunk_id", ["text_for_embedding"])
        return self._built["sparse"]


@dataclass(frozen=True)
class Ranking:
    dense_candidates: int = 50
    lexical_candidates: int = 50
    rrf_k: int = fusion.K


def search(index: Index, queries: DataFrame, mode: str = "hybrid-fused", limit: int = 10, filters: Scope | None = None, score_threshold: float | None = None, ranking: Ranking | None = None) -> DataFrame:
    """query_id, rank, score, id, per-leg ranks and scores, and the chunk's columns; queries: query_id, query.

    Filters come before candidates are chosen. The threshold is one of the dense leg and changes no other
    mode. Lexical modes never touch the embedder. "hybrid" fuses dense with lexical, "hybrid-fused" with sparse.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    filters = filters or Scope()
    ranking = ranking or Ranking()
    kept = filters.apply(index.chunks, "like" if mode in ("lexical", "hybrid") else "words").select(F.col("chunk_id").alias("id")) if filters else None

    def vectors(n: int, threshold: float | None) -> DataFrame:
        points = index.vectors if kept is None else index.vectors.join(kept, "id", "left_semi")
        return dense.nearest(points, dense.embed_queries(queries, index.embed, index.query_prefix), n, "cosine", threshold)

    if mode == "dense":
        found = vectors(limit, score_threshold)
    elif mode in ("lexical", "sparse"):
        found = lexical.bm25(index.lexical() if mode == "lexical" else index.sparse(), queries, limit, kept)
    else:
        second = ("lexical", index.lexical()) if mode == "hybrid" else ("sparse", index.sparse())
        legs = {"dense": vectors(ranking.dense_candidates, score_threshold if mode == "hybrid" else None), second[0]: lexical.bm25(second[1], queries, ranking.lexical_candidates, kept)}
        found = fusion.fuse(legs, ["query_id"], ranking.rrf_k, limit)
    payload = index.chunks.withColumnRenamed("chunk_id", "id")
    joined = found.join(payload, "id")
    # ids without a chunk drop out, and ranks close up
    order = W.partitionBy("query_id").orderBy("rank")
    return joined.withColumn("rank", F.row_number().over(order))


def clamp_limit(limit: int | None, default: int = 5, most: int = 20) -> int:
    return min(max(1, limit or default), most)


# what a response tells of a result, where the index has it
RESULT = ("rank", "score", "id", "source_name", "source_type", "area", "language", "path", "rel_path", "start_line", "end_line", "symbol_kind", "symbol_name", "symbol_fqn")


def respond(results: DataFrame, include_text: bool = True, max_text_chars: int = 3000) -> DataFrame:
    """One row per query: query_id, count, results (an array of structs in order of rank)."""
    columns = [c for c in RESULT if c in results.columns]
    rows = results.withColumn("path", F.coalesce(F.nullif(F.col("rel_path"), F.lit("")), F.col("path")))
    fields = [F.col(c) for c in columns] + ([truncated(F.coalesce("text", F.lit("")), max_text_chars or 3000).alias("text")] if include_text else [])
    return rows.groupBy("query_id").agg(F.count("*").cast("int").alias("count"), F.array_sort(F.collect_list(F.struct(*fields))).alias("results"))


def one_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("q", text)], "query_id string, query string")


def title(results: DataFrame) -> DataFrame:
    """results with a title: score|source|language|path, and :first-last line where known."""
    known = "start_line" in results.columns
    lines = F.when(F.col("start_line").isNotNull(), F.format_string(":%d-%d", "start_line", "end_line")).otherwise("") if known else F.lit("")
    dash = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-"))
    return results.withColumn("title", F.concat_ws("|", F.coalesce(F.format_string("%.6f", F.col("score").cast("double")), F.lit("-")), dash("source_name"), dash("language"), F.concat(F.coalesce(F.nullif(F.col("rel_path"), F.lit("")), dash("path")), lines)))
