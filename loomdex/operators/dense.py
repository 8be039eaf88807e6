"""Dense retrieval: embedding with memory, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions.memory import guard
from loomdex.sources.shared import shared_table

QUERY_BYTES = 64 << 20  # queries of one pass, which go to every task
CELLS = 8 << 20  # scores that a task holds at once


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder without a model: signed hashes of words, length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for w in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1.0 if h >> 16 & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


# embedders by the name of their provider; each takes the model's name. Others are registered by whoever has a model.
PROVIDERS: dict[str, Callable[[str], Callable[[list[str]], np.ndarray]]] = {"hashing": lambda model: hashing_embedder(int(model.rpartition("-")[2] or 64))}
_LOADED: dict[tuple[str, str], Callable[[list[str]], np.ndarray]] = {}


def embedder(provider: str, model: str, batch_size: int = 32) -> Callable[[list[str]], np.ndarray]:
    """An embedder that loads its model in each Python worker once, on first use, and embeds `batch_size` texts at a time."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}; one of {', '.join(sorted(PROVIDERS))}")
    make = PROVIDERS[provider]

    def embed(texts: list[str]) -> np.ndarray:
        if (provider, model) not in _LOADED:
            _LOADED[provider, model] = make(model)
        loaded = _LOADED[provider, model]
        parts = [np.asarray(loaded(texts[at : at + batch_size]), dtype=np.float32) for at in range(0, len(texts), batch_size)]
        return np.concatenate(parts) if parts else np.zeros((0, 0), dtype=np.float32)

    return embed


def vector_size(embed: Callable[[list[str]], np.ndarray]) -> int:
    """The length of an embedder's vectors, found by embedding one word."""
    return int(np.asarray(embed(["test"])).shape[1])


def text_hash(prefix: str, text: str = "text"):
    return F.sha2(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))), 256)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, prefix: str = "") -> DataFrame:
    """text_hash, text: each text not in the cache of this model, once."""
    hashed = texts.select(text_hash(prefix).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")).groupBy("text_hash").agg(F.min("text").alias("text"))
    return hashed.join(cache.where(F.col("model_name") == model).select("text_hash"), "text_hash", "left_anti")


def embed_cached(texts: DataFrame, cache: DataFrame, model: str, embed: Callable[[list[str]], np.ndarray], prefix: str = "", max_memory_mb: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts with `text_hash` and `vector`, the new rows of the cache). Every distinct text is embedded once."""
    misses = cache_misses(texts, cache, model, prefix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            guard(max_memory_mb, "embedding")
            vectors = embed([prefix + t for t in pdf["text"]]) if len(pdf) else []
            yield pd.DataFrame({"text_hash": pdf["text_hash"], "vector": list(vectors)})

    made = misses.mapInPandas(run, "text_hash string, vector array<float>")
    new = shared_table(made.select(F.lit(model).alias("model_name"), "text_hash", F.size("vector").alias("dim"), "vector"), "embedded")
    known = cache.where(F.col("model_name") == model).groupBy("text_hash").agg(F.max("vector").alias("vector"))
    vectors = known.unionByName(new.select("text_hash", "vector"))
    hashed = texts.withColumn("text_hash", text_hash(prefix))
    return hashed.join(vectors, "text_hash", "left"), new


def cache_statistics(texts: DataFrame, cache: DataFrame, model: str, prefix: str = "") -> DataFrame:
    """hits, misses: a text repeated in the batch is a hit after the first."""
    hashed = texts.select(text_hash(prefix).alias("text_hash"))
    known = cache.where(F.col("model_name") == model).select("text_hash").distinct().withColumn("known", F.lit(True))
    agg = hashed.join(known, "text_hash", "left").agg(F.count("*").alias("total"), F.countDistinct(F.when(F.col("known").isNull(), F.col("text_hash"))).alias("misses"))
    return agg.select((F.col("total") - F.col("misses")).alias("hits"), "misses")


def nearest(points: DataFrame, queries: DataFrame, limit: int | None = 10, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """query_id, id, score, rank: exact nearest points of every query; points have `id`, `vector`, queries `query_id`, `vector`.

    cosine and dot: greater is better; l2: less. `threshold` keeps scores at least (l2: at most) so good. Without
    `limit` all of these come out, and without rank. The queries, a stated set, go to all tasks and meet the
    points block by block in matrix products; a task keeps `limit` rows of each query, so the points are never
    shuffled. Queries above QUERY_BYTES are searched in several passes, each written before the next. NULL and
    empty vectors take no part. Equal scores (to nine decimals) rank by id.
    """
    if limit is None and threshold is None:
        raise ValueError("neither a limit nor a threshold")
    usable = queries.where("query_id is not null and vector is not null and size(vector) > 0").select("query_id", "vector")
    numbers = usable.agg(F.sum(F.size("vector"))).head()[0] or 0
    passes = max(1, -(-8 * numbers // QUERY_BYTES))
    if passes == 1:
        return _nearest(points, usable, limit, metric, threshold)
    number = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    parts = [shared_table(_nearest(points, usable.where(number == n), limit, metric, threshold), "nearest") for n in range(passes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """A row for each query, a column for each point, to nine decimals, greater is better; -inf where there is no direction."""
    if metric == "l2":
        return -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T, 0.0)).round(9)
    s = q @ x.T
    if metric == "cosine":
        lengths = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        s = np.divide(s, lengths, out=np.full_like(s, -np.inf), where=lengths > 0)
    return s.round(9)


def _best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (query number, id, score) the `limit` best of each query."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - first < limit
    return q[keep], ids[keep], s[keep]


def _nearest(points: DataFrame, queries: DataFrame, limit: int | None, metric: str, threshold: float | None) -> DataFrame:
    spark = points.sparkSession
    rows = queries.toPandas()
    asked = np.stack(rows["vector"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 1))
    shipped = spark.sparkContext.broadcast((asked, rows["query_id"].to_numpy()))
    sign = -1.0 if metric == "l2" else 1.0
    least = -np.inf if threshold is None else sign * threshold

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, names = shipped.value
        frame = lambda at, ids, s: pd.DataFrame({"query_id": names[at], "id": ids, "score": sign * s})
        held = None
        for pdf in batches:
            block = max(1, CELLS // max(1, len(q)))
            for start in range(0, len(pdf) if len(q) else 0, block):
                part = pdf.iloc[start : start + block]
                s = scores(q, np.stack(part["vector"].to_numpy()).astype(np.float64), metric)
                enough = np.isfinite(s) & (s >= least)
                if limit is not None and s.shape[1] > limit:  # all that tie with the last stay until ids decide
                    enough &= s >= np.partition(s, s.shape[1] - limit, axis=1)[:, [s.shape[1] - limit]]
                if held is not None:
                    enough &= s >= worst[:, None]
                at, to = np.nonzero(enough)
                ids, found = part["id"].to_numpy()[to], s[at, to]
                if limit is None:
                    yield frame(at, ids, found)
                    continue
                if held is not None:
                    at, ids, found = (np.concatenate(two) for two in zip(held, (at, ids, found), strict=True))
                held = _best(at, ids, found, limit)
                worst = np.full(len(q), -np.inf)  # of a full list: what comes later must reach it
                full = np.bincount(held[0], minlength=len(q)) == limit
                last = np.searchsorted(held[0], np.flatnonzero(full), side="right") - 1
                worst[full] = held[2][last]
        if held is not None:
            yield frame(*held)

    kind = queries.schema["query_id"].dataType.simpleString()
    usable = points.where("id is not null and vector is not null and size(vector) > 0").select("id", "vector")
    found = usable.mapInPandas(run, f"query_id {kind}, id {points.schema['id'].dataType.simpleString()}, score double")
    if limit is None:
        return found
    order = W.partitionBy("query_id").orderBy(F.asc("score") if metric == "l2" else F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def embed_queries(queries: DataFrame, embed: Callable[[list[str]], np.ndarray], prefix: str = "") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"query_id": pdf["query_id"], "vector": list(embed([prefix + (t or "") for t in pdf["query"]]))})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "query").mapInPandas(run, f"query_id {kind}, vector array<float>")


__all__ = ["cache_misses", "cache_statistics", "embed_cached", "embed_queries", "hashing_embedder", "nearest", "text_hash", "vector_size"]
