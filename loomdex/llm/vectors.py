"""Most similar vectors for every vector: a block matrix join over int8 tiles.

Vectors are put into cells (k-means on a bounded sample), neighbouring cells into groups of bounded
size. A vector goes to its own group once and, as a query, to every other group that holds one of its
`probes` nearest cells. A group above the bound is cut into blocks of base rows and blocks of queries, each pair
of which is a task, so no task holds a hot cell. In a task, each cell's tile is a product of int8 codes (computed exactly in
float32, since 96 * 127 * 127 < 2**24 and longer vectors are cut into such spans). With the quantisation
error of both sides it bounds every cosine; only pairs whose upper bound reaches the k-th lower bound are
recomputed from the float vectors, and best-k lists of tiles are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.sources.shared import shared_table, small_side

SAMPLE_ROWS = 16_384  # of the training sample of one model, or SAMPLED for each cell where these are more
SAMPLED = 4
MAX_CELLS = 32_768  # the square root of about a billion rows; bounds the sample and what the driver and every task hold
BLOCK_ROWS = 16_384  # rows of a base block; with QUERY_ROWS of queries the unit a task holds
QUERY_ROWS = 8 * BLOCK_ROWS
PROBES = 8
CODE_SPAN = 1_024  # numbers whose int8 products a float32 sum holds exactly
SALTS = 16
MOST_TASKS = 20_000
SMALL_KEYS = 100_000  # keys with several rows that may be broadcast, about 10 MB


def newest_vectors(rows: DataFrame) -> DataFrame:
    """The usable vectors of the newest row of each (model_name, text_hash).

    Usable: `dim` numbers, all finite, not all zero. A NULL key is no key and is left out; a NULL
    created_at is older than any other; rows equal in time are decided by their values, so that
    repeated runs agree. If the newest row is unusable, the key has no vector.
    """
    rows = rows.select("model_name", "text_hash", "dim", "vector", "created_at").where("model_name is not null and text_hash is not null")
    keys = ["model_name", "text_hash"]
    repeated = shared_table(rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").select(*keys), "p1-repeated")
    repeated = small_side(repeated, SMALL_KEYS)
    order = F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp")).alias("t"), "dim", "vector")
    newest = rows.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.max(order).alias("row"))
    newest = newest.select(*keys, F.col("row.dim").alias("dim"), F.col("row.vector").alias("vector"))
    single = rows.join(repeated, keys, "left_anti").select(*keys, "dim", "vector")
    return newest.unionByName(single).where(usable("vector", "dim")).select(*keys, "vector")


def usable(vector: str, dim: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == F.col(dim)) & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def unit(vectors: pd.Series) -> np.ndarray:
    """A matrix of rows of length 1; scaled by the largest number first, so that no square overflows or vanishes."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def similar_vectors(rows: DataFrame, k: int = 5, probes: int = PROBES, block_rows: int = BLOCK_ROWS, seed: int = 7, query_rows: int = QUERY_ROWS) -> DataFrame:
    """model_name, text_hash, neighbour_hash, cosine, rank: the k best neighbours of every usable vector.

    With `probes` of MAX_CELLS or more every cell is searched and the result is exact, at quadratic cost.

    Only vectors of one model and length are compared. Equal cosines rank by neighbour_hash; which of several
    different directions with equal cosines is the k-th is left open. Vectors that
    agree in direction to five decimals are one class: one representative is searched, the class's members
    are each other's first neighbours, so a hot group of copies costs no more than its rows. An empty
    table gives no rows; other columns of `rows` are ignored.
    """
    spark = rows.sparkSession
    centroids = train_cells(rows, seed)
    cells = spark.sparkContext.broadcast(centroids)
    located = shared_table(
        newest_vectors(rows).mapInPandas(
            lambda batches: locate(batches, cells.value, probes), "model string, text_hash string, v array<float>, cells array<int>, direction binary"
        ).withColumn("uid", F.monotonically_increasing_id()),
        "p1-located",
    )
    members, first = copy_classes(located.select("model", "text_hash", "uid", "direction"), k)
    found = search_representatives(located, members, centroids, k, block_rows, query_rows)
    pairs = expand_classes(found, members, first, k)
    named = located.select("model", "text_hash", "uid")
    # names come last and one side at a time: ranking and the second join share one partitioning by uid
    spelled = pairs.join(named.select(F.col("uid").alias("near"), F.col("text_hash").alias("neighbour_hash")), "near").drop("near")
    order = W.partitionBy("uid").orderBy(F.desc("cosine"), "neighbour_hash")
    ranked = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(named, "uid").select(F.regexp_replace("model", "/[0-9]+$", "").alias("model_name"), "text_hash", "neighbour_hash", "cosine", "rank")


def train_cells(rows: DataFrame, seed: int) -> dict[str, np.ndarray]:
    """Centroids by "model/length", about sqrt(rows) of each, MAX_CELLS at most, from a sample of bounded size."""
    ok = rows.where(usable("vector", "dim") & F.col("model_name").isNotNull()).withColumn("model", F.concat_ws("/", "model_name", F.size("vector").cast("string")))
    counts = {r["model"]: r["n"] for r in ok.groupBy("model").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    cells = {m: int(min(MAX_CELLS, max(1, round(n**0.5)))) for m, n in counts.items()}
    most = {m: max(SAMPLE_ROWS, SAMPLED * k) for m, k in cells.items()}
    share = F.create_map(*[F.lit(x) for m, n in counts.items() for x in (m, min(1.0, 0.9 * most[m] / n))])
    draw = (F.pmod(F.xxhash64(F.lit(seed), "text_hash"), F.lit(1_000_003)) / 1_000_003.0) < share[F.col("model")]
    sample = ok.where(draw).select("model", "vector")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        model = pdf["model"].iloc[0]
        x = unit(pdf["vector"])[: most[model]]
        k = min(cells[model], max(1, len(x) // 2))
        return pd.DataFrame({"model": model, "c": list(kmeans(x, k, seed))})

    out = sample.groupBy("model").applyInPandas(fit, "model string, c array<float>").collect()
    cells: dict[str, list] = {}
    for r in out:
        cells.setdefault(r["model"], []).append(r["c"])
    return {m: np.asarray(c, dtype=np.float32) for m, c in cells.items()}


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    x = x[np.lexsort(x.T[:4])]  # the order of arrival has no influence
    c = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        home = nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1)
        keep = norms > 1e-6
        c[keep] = sums[keep] / norms[keep, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest centres of each row, nearest first."""
    n = min(n, len(c))
    out = np.empty((len(x), n), dtype=np.int32)
    for at in range(0, len(x), 4096):
        s = x[at : at + 4096] @ c.T
        top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(n), (len(s), 1))
        order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[at : at + 4096] = np.take_along_axis(top, order, 1)
    return out


def locate(batches: Iterator[pd.DataFrame], cells: dict[str, np.ndarray], probes: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if pdf.empty:
            continue
        model = pdf["model_name"] + "/" + pdf["vector"].map(len).astype(str)
        for name, part in pdf.groupby(model, sort=False):
            x = unit(part["vector"])
            c = cells.get(name)
            if c is None:  # a model all of whose rows the sample missed
                c = np.zeros((1, x.shape[1]), dtype=np.float32)
            codes = np.rint(x * 1e5).astype(np.int32)
            direction = [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in codes]
            yield pd.DataFrame({"model": name, "text_hash": part["text_hash"].to_numpy(), "v": list(x), "cells": list(nearest(x, c, probes)), "direction": direction})


def copy_classes(ids: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """members: every member of a class of two or more, with its representative and the class's size. first: its k + 1 smallest."""
    classes = ids.groupBy("model", "direction").agg(F.min(F.struct("text_hash", "uid")).alias("least"), F.count("*").alias("size")).where("size > 1")
    classes = classes.select("model", "direction", F.col("least.uid").alias("rep"), "size")
    members = shared_table(ids.join(classes, ["model", "direction"]).select("rep", "size", "text_hash", "uid"), "p1-copies")
    order = W.partitionBy("rep").orderBy("text_hash")
    first = members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("rep", F.col("uid").alias("copy"))
    return members.drop("text_hash"), first


def search_representatives(located: DataFrame, members: DataFrame, centroids: dict[str, np.ndarray], k: int, block_rows: int, query_rows: int) -> DataFrame:
    spark = located.sparkSession
    later = small_side(members.where("uid != rep").select("uid"), 10 * SMALL_KEYS)
    reps = located.join(later, "uid", "left_anti")
    sizes = reps.groupBy("model", F.element_at("cells", 1).alias("cell")).agg(F.count("*").alias("n")).collect()
    grouped = spark.sparkContext.broadcast(plan_groups(sizes, centroids, block_rows))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for model, part in pdf.groupby("model"):
                goes = np.sort(np.asarray(grouped.value[model][0])[np.stack(part["cells"].to_numpy())], axis=1)
                new = np.diff(goes, axis=1, prepend=-1) > 0
                number, n = np.unique(goes[new], return_counts=True)
                yield pd.DataFrame({"model": model, "grp": number, "n": n})

    asked = reps.select("model", "cells").mapInPandas(ask, "model string, grp int, n bigint").groupBy("model", "grp").agg(F.sum("n").alias("n")).collect()
    parts = {(r["model"], r["grp"]): -(-r["n"] // query_rows) for r in asked}
    groups = {m: (g, blocks, [max(1, parts.get((m, i), 1)) for i in range(len(blocks))]) for m, (g, blocks) in grouped.value.items()}
    plan = spark.sparkContext.broadcast({m: (i, *groups[m]) for i, m in enumerate(sorted(groups))})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for model, uid, v, cells in zip(pdf["model"], pdf["uid"], pdf["v"], pdf["cells"], strict=True):
                number, groups, blocks, parts = plan.value[model]
                home = groups[cells[0]]
                goes: dict[int, list[int]] = {}
                for c in cells:
                    goes.setdefault(groups[c], []).append(int(c))
                mixed = uid * 0x9E3779B97F4A7C15 >> 24
                for g, probed in goes.items():
                    own = (mixed >> 16) % blocks[g] if g == home else -1
                    asks = mixed % parts[g]
                    for b in range(blocks[g]):  # as a query
                        out.append((number, g, b, asks, uid, v, probed, int(cells[0]) if b == own else -1))
                    for q in range(parts[g] if own >= 0 else 0):  # as a base row for the other queries
                        if q != asks:
                            out.append((number, g, own, q, uid, v, [], int(cells[0])))
            yield pd.DataFrame(out, columns=["model", "grp", "block", "part", "uid", "v", "probed", "home"])

    schema = "model int, grp int, block int, part int, uid bigint, v array<float>, probed array<int>, home int"
    spreaded = reps.select("model", "uid", "v", "cells").mapInPandas(spread, schema)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["uid"].to_numpy()
        q, b, s = tile_join(np.stack(pdf["v"].to_numpy()).astype(np.float32), ids, pdf["home"].to_numpy(), pdf["probed"].to_numpy(), k)
        return pd.DataFrame({"uid": ids[q], "near": ids[b], "cosine": s})

    # twice as many partitions as units, so that what a task reads does not grow with the table
    keys = ["model", "grp", "block", "part"]
    units = sum(b * q for _, blocks, parts in groups.values() for b, q in zip(blocks, parts, strict=True))
    spreaded = spreaded.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * units, MOST_TASKS)), *keys)
    found = spreaded.groupBy(*keys).applyInPandas(match, "uid bigint, near bigint, cosine double")
    order = W.partitionBy("uid").orderBy(F.desc("cosine"), "near")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def plan_groups(sizes: list, centroids: dict[str, np.ndarray], block_rows: int) -> dict[str, tuple[list[int], list[int]]]:
    """For each model, the group of every cell and the number of base blocks of every group.

    Cells are taken in the order of a walk to the nearest cell not yet taken, so that a group, a run of
    the walk of at most `block_rows` rows, holds cells near each other. A cell above that is a group alone
    and gets several blocks.
    """
    counts: dict[str, dict[int, int]] = {}
    for r in sizes:
        counts.setdefault(r["model"], {})[r["cell"]] = r["n"]
    plan = {}
    for model, n in counts.items():
        c = centroids.get(model)
        total = len(c) if c is not None else 1
        walk, left = [], np.ones(total, dtype=bool)
        at = int(np.argmin(c @ c.mean(axis=0))) if c is not None else 0
        for _ in range(total):
            walk.append(at)
            left[at] = False
            if left.any() and c is not None:
                at = int(np.argmax(np.where(left, c @ c[at], -np.inf)))
        groups, blocks, held = [0] * total, [], 0
        for cell in walk:
            rows = n.get(cell, 0)
            if not blocks or held + rows > block_rows:
                blocks.append(1)
                held = 0
            held += rows
            groups[cell] = len(blocks) - 1
            blocks[-1] = max(1, -(-held // block_rows))
        plan[model] = (groups, blocks)
    return plan


def int8_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of -127..127 (as float32, for the fast exact product), the scale of each row, and the length of its error."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x.astype(np.float64) - codes * scale[:, None].astype(np.float64), axis=1)
    return codes.astype(np.float32), scale, error.astype(np.float32)


def tile_join(x: np.ndarray, ids: np.ndarray, home: np.ndarray, probed: np.ndarray, k: int, tile: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of queries and neighbours, and cosines: the k best of each query among rows whose home cell it probes."""
    codes, scale, error = int8_codes(x)
    length = np.float32(1.0) + error  # of the decoded vector, at most
    asks: dict[int, list[int]] = {}
    for row, cells in enumerate(probed):
        for c in cells:
            asks.setdefault(int(c), []).append(row)
    best_s = np.full((len(x), k), -2.0)
    best_i = np.full((len(x), k), -1, dtype=np.int64)
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    by_cell = np.argsort(home, kind="stable")
    bounds = np.searchsorted(home[by_cell], np.arange(home.max() + 2)) if len(home) else []
    for cell, rows in asks.items():
        if cell > home.max():
            continue
        base = by_cell[bounds[cell] : bounds[cell + 1]]
        if not len(base):
            continue
        for at in range(0, len(rows), tile):
            q = np.asarray(rows[at : at + tile])
            for bt in range(0, len(base), tile):
                b = base[bt : bt + tile]
                product = np.zeros((len(q), len(b)), dtype=np.float64 if x.shape[1] > CODE_SPAN else np.float32)
                for s in range(0, x.shape[1], CODE_SPAN):
                    product += codes[q, s : s + CODE_SPAN] @ codes[b, s : s + CODE_SPAN].T
                about = product * (scale[q, None] * scale[None, b])
                slack = error[q, None] * length[None, b] + length[q, None] * error[None, b] + np.float32(1e-5)
                about[q[:, None] == b[None, :]] = -9.0
                low = about - slack
                kth = np.partition(low, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else np.full(len(q), -2.0)
                floor = np.maximum(kth, best_s[q, -1])
                qi, bi = np.nonzero((about + slack >= floor[:, None]) & (about > -5))
                if not len(qi):
                    continue
                exact = np.einsum("ij,ij->i", x[q[qi]].astype(np.float64), x[b[bi]].astype(np.float64))
                merge_best(best_s, best_i, rank, q, qi, b[bi], exact, k)
    q, at = np.nonzero(best_i >= 0)
    return q, best_i[q, at], np.minimum(best_s[q, at], 1.0)


def merge_best(best_s: np.ndarray, best_i: np.ndarray, rank: np.ndarray, q: np.ndarray, qi: np.ndarray, found: np.ndarray, exact: np.ndarray, k: int) -> None:
    """Merge a tile's survivors into the bounded best-k list of each of its queries (cosine down, then id up)."""
    rows = np.concatenate([np.repeat(np.arange(len(q)), k), qi])
    s = np.concatenate([best_s[q].ravel(), exact])
    i = np.concatenate([best_i[q].ravel(), found])
    order = np.lexsort((np.where(i < 0, len(rank), rank[i]), -s, rows))
    rows, s, i = rows[order], s[order], i[order]
    start = np.searchsorted(rows, np.arange(len(q)))
    take = start[:, None] + np.arange(k)[None, :]
    best_s[q], best_i[q] = s[take], i[take]


def expand_classes(found: DataFrame, members: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """uid, near, cosine with the members of classes in place of representatives, on both sides."""
    wide = found.join(first.withColumnRenamed("rep", "near"), "near", "left").select("uid", F.coalesce("copy", "near").alias("near"), "cosine")
    # a class of more than k members finds all its neighbours in itself, so only small classes take over others
    small = members.where(F.col("size") <= k).select(F.col("rep").alias("uid"), F.col("uid").alias("member"))
    large = members.where((F.col("size") > k) & (F.col("uid") == F.col("rep"))).select("uid")
    taken = wide.join(large, "uid", "left_anti").join(small, "uid", "left").select(F.coalesce("member", "uid").alias("uid"), "near", "cosine")
    salt = F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")
    spread = first.select("rep", F.col("copy").alias("near"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = members.withColumn("salt", salt).join(spread, ["rep", "salt"]).where("uid != near")
    return taken.unionByName(own.select("uid", "near", F.lit(1.0).alias("cosine")))
