"""Filling containers of fixed capacity: a grouping genetic algorithm on islands.

A text longer than the capacity gives full pieces and a rest; every other item stays whole. Items are put
into shards of bounded size. Several islands evolve packings of one shard in separate tasks: crossover
injects whole well-filled bins of one parent into the other, removes the bins that hold their items, and
puts displaced items back by best fit. Between rounds the best packing of each island moves to the next.
The worst bins of all shards are pooled and packed again, so that the rests of shards are not lost; what a
shard evolves for is therefore no space left in the bins it keeps, and only the last pool for few bins.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.sources.shared import shared_table

SHARD_ITEMS = 2_000
ISLANDS = 3
ROUNDS = 2
GENERATIONS = 30  # of a round on a shard; an island ends where nothing is left to gain, or nothing was gained for PATIENCE of them
LAST_GENERATIONS = 120  # of a round on the last pool, which has the patience for all
PATIENCE = 8
POPULATION = 5
TASKS_PER_CORE = 4
POOLED = 0.06  # share of a shard's bins, the worst filled, that are packed again with those of other shards
LEVELS = 3


def token_count(text: Column) -> Column:
    """WordPunct tokens: runs of letters, digits and underscores, and runs of other signs that are no space."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\u0085   -     　\u001c-\u001f]+"))


def items_of(documents: DataFrame, capacities: DataFrame) -> DataFrame:
    """container_kind, capacity, doc_id, piece, start_token, size: whole texts, or pieces of those above the capacity."""
    size = F.coalesce(F.col("n_tokens").cast("long"), token_count(F.coalesce("text", F.lit(""))).cast("long"))
    docs = documents.where("doc_id is not null").select("doc_id", F.greatest(size, F.lit(0)).alias("tokens"))
    kinds = capacities.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    known = [F.struct(F.lit(r["container_kind"]).alias("container_kind"), F.lit(r["capacity"]).alias("capacity")) for r in kinds.collect()]  # a fixed few
    each = F.explode(F.array(*known)) if known else F.explode(F.array().cast("array<struct<container_kind:string,capacity:bigint>>"))
    both = docs.withColumn("kind", each).select("doc_id", "tokens", "kind.*")
    last = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1, F.lit(0))
    pieces = both.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece") * F.col("capacity")
    return pieces.select("container_kind", "capacity", "doc_id", "piece", start.alias("start_token"), F.least(F.col("capacity"), F.col("tokens") - start).alias("size"))


class Packing:
    """Bins as lists of item numbers, which packings share and nobody changes, with the space left in each."""

    __slots__ = ("_home", "bins", "left")

    def __init__(self, bins: list[list[int]], left: list[int]):
        self.bins, self.left, self._home = bins, left, None

    def home(self) -> dict[int, int]:
        """The bin of every item of a packing that is complete."""
        if self._home is None:
            self._home = {item: n for n, items in enumerate(self.bins) for item in items}
        return self._home

    def fitness(self, capacity: int) -> float:
        """Mean squared fill: more for a few full bins and one nearly empty than for the same content spread."""
        return sum((1 - x / capacity) ** 2 for x in self.left) / max(1, len(self.left))

    def wasted(self) -> int:
        """The space left in the bins that are not pooled."""
        left = sorted(self.left)
        return sum(left[: max(0, len(left) - pooled_bins(len(left)))])


def pooled_bins(bins: int) -> int:
    """How many of a shard's bins go to the pool: POOLED of them, two at least."""
    return max(2, math.ceil(bins * POOLED))


def place(packing: Packing, order: Iterable[int], sizes: list[int], capacity: int) -> Packing:
    """Put items, in the order given, each where least space stays; into a new bin where it fits nowhere."""
    bins, left = packing.bins, packing.left
    space = sorted((x, b) for b, x in enumerate(left) if x > 0)
    for item in order:
        size = sizes[item]
        at = bisect_left(space, (size, -1))
        if at < len(space):
            free, b = space.pop(at)
            bins[b] = [*bins[b], item]
        else:
            free, b = capacity, len(bins)
            bins.append([item])
            left.append(capacity)
        left[b] = free - size
        if left[b] > 0:
            insort(space, (left[b], b))
    return packing


def best_fit(packing: Packing, items: Iterable[int], sizes: list[int], capacity: int) -> Packing:
    """`place`, largest first."""
    return place(packing, sorted(items, key=lambda i: (-sizes[i], i)), sizes, capacity)


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Well-filled bins of b go whole into a, unless they would break a full bin of it; bins of a with any of their items go, the other items of these are put back by best fit."""
    home = a.home()
    order = rng.sample(range(len(b.bins)), len(b.bins))
    order.sort(key=b.left.__getitem__)
    full = order[: b.left.count(0)]
    chosen = [i for i in (full if len(full) > 3 else order[: max(3, len(order) // 3)]) if rng.random() < 0.6] or order[:1]
    bins: list[list[int]] = []
    left: list[int] = []
    taken: set[int] = set()
    broken: set[int] = set()
    for i in chosen:
        met = {home[item] for item in b.bins[i]}
        if all(a.left[n] > 0 for n in met):
            bins.append(b.bins[i])
            left.append(b.left[i])
            taken.update(b.bins[i])
            broken |= met
    displaced: list[int] = []
    for n, (items, free) in enumerate(zip(a.bins, a.left, strict=True)):
        if n in broken:
            displaced += [x for x in items if x not in taken]
        else:
            bins.append(items)
            left.append(free)
    return best_fit(Packing(bins, left), displaced, sizes, capacity)


def mutate(p: Packing, sizes: list[int], capacity: int, rng: random.Random, share: float = 0.3) -> Packing:
    """Empty a share of the bins that are not full, and put their items back in an order that is only roughly that of size."""
    gone = {i for i, free in enumerate(p.left) if free > 0 and rng.random() < share}
    rest = Packing([x for i, x in enumerate(p.bins) if i not in gone], [x for i, x in enumerate(p.left) if i not in gone])
    noise = {item: sizes[item] * rng.uniform(0.7, 1.0) for i in sorted(gone) for item in p.bins[i]}
    return place(rest, sorted(noise, key=lambda i: -noise[i]), sizes, capacity)


def evolve(sizes: list[int], capacity: int, elites: list[list[int]], seed: int, last: bool = True) -> tuple[list[int], bool]:
    """(bin of every item, whether nothing is left to gain); `elites` are such lists from before.

    `last`: few bins count; else the space wasted in the bins that are not pooled.
    """
    rng = random.Random(seed)
    everything = list(range(len(sizes)))
    least = -(-sum(sizes) // capacity) if sizes else 0
    score = (lambda p: (len(p.bins), -p.fitness(capacity))) if last else (lambda p: (p.wasted(), len(p.bins)))
    perfect = (lambda p: len(p.bins) <= least) if last else (lambda p: p.wasted() == 0)
    population = [_from_list(e, sizes, capacity) for e in elites]
    if not population:
        population.append(best_fit(Packing([], []), everything, sizes, capacity))
    if not perfect(min(population, key=score)):
        while len(population) < POPULATION:
            population.append(place(Packing([], []), rng.sample(everything, len(everything)), sizes, capacity))
        gained, best = 0, None
        for turn in range(LAST_GENERATIONS if last else GENERATIONS):
            population.sort(key=score)
            if best is None or score(population[0]) < best:
                gained, best = turn, score(population[0])
            if perfect(population[0]) or (not last and turn - gained >= PATIENCE):
                break
            parents = population[: POPULATION // 2 + 1]
            children = []
            for _ in range(POPULATION - 2):
                child = crossover(*rng.sample(parents, 2), sizes, capacity, rng)
                children.append(mutate(child, sizes, capacity, rng) if rng.random() < 0.7 else child)
            population = [*population[: POPULATION // 2], *children]
    top = min(population, key=score)
    out = [0] * len(sizes)
    for b, items in enumerate(top.bins):
        for item in items:
            out[item] = b
    return out, perfect(top)


def _from_list(bin_of: list[int], sizes: list[int], capacity: int) -> Packing:
    bins: dict[int, list[int]] = {}
    for item, b in enumerate(bin_of):
        bins.setdefault(b, []).append(item)
    lists = list(bins.values())
    return Packing(lists, [capacity - sum(sizes[i] for i in items) for items in lists])


_STATE = "container_kind string, level int, shard int, island int, elite array<int>, done boolean, score bigint"


def pack(documents: DataFrame, capacities: DataFrame) -> DataFrame:
    """container_kind, container_id, doc_id, piece, start_token, n_tokens: one row per item; every token of every text is in one container.

    doc_id is the key of `documents`; n_tokens is counted anew where NULL, a NULL text has none. An item of 0
    tokens goes into any container. Rows with NULL doc_id, kind or a capacity below 1 are left out. Empty
    tables give no rows.
    """
    items = items_of(documents, capacities)
    # a full piece is a container of its own
    full = items.where("size = capacity").withColumn("container_id", F.concat_ws("-", F.lit("f"), "doc_id", "piece"))
    rest = shared_table(items.where("size < capacity"), "p8-items")
    placed = [full]
    for level in range(LEVELS):
        counts = {r["container_kind"]: r["n"] for r in rest.groupBy("container_kind").agg(F.count("*").alias("n")).collect()}
        if not counts:
            break
        shards = {kind: max(1, round(n / SHARD_ITEMS)) for kind, n in counts.items()}
        last = level == LEVELS - 1 or max(shards.values()) == 1
        packed = _pack_level(rest, level, shards, last)
        placed.append(packed.where("not pooled").drop("pooled"))
        if last:
            break
        rest = packed.where("pooled").drop("pooled", "container_id")
    out = placed[0].select(*_COLUMNS)
    for part in placed[1:]:
        out = out.unionByName(part.select(*_COLUMNS))
    return out.withColumnRenamed("size", "n_tokens")


_COLUMNS = ["container_kind", "container_id", "doc_id", "piece", "start_token", "size"]


def _pack_level(rest: DataFrame, level: int, shards: dict[str, int], last: bool) -> DataFrame:
    number = F.create_map(*[F.lit(x) for kind, n in shards.items() for x in (kind, n)])
    sharded = rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), "doc_id", "piece"), number[F.col("container_kind")].cast("long")).cast("int"))
    # one row per shard: items in a fixed order, so that elites may name them by position
    item = F.struct("size", "doc_id", "piece", "start_token")
    groups = sharded.groupBy("container_kind", "shard", "capacity").agg(F.array_sort(F.collect_list(item)).alias("items"))
    groups = shared_table(groups, "p8-shards")
    islands = groups.select("container_kind", "shard", "capacity", F.col("items.size").alias("sizes")).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    state = None
    for turn in range(ROUNDS):
        if state is None:
            todo = islands.withColumn("elites", F.array().cast("array<array<int>>"))
        else:
            # every island goes on with its own best and that of its neighbour
            goes = state.withColumn("to", F.explode(F.array_distinct(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS))))))
            elites = goes.groupBy("container_kind", "shard", F.col("to").alias("island")).agg(F.collect_list("elite").alias("elites"), F.bool_or("done").alias("done"))
            todo = islands.join(elites.where("not done").drop("done"), ["container_kind", "shard", "island"])
        state_now = _turn(todo, turn, last, sum(shards.values()) * ISLANDS)
        if state is not None:
            state_now = state_now.unionByName(state.where("done"))
        state = shared_table(state_now, "p8-state")
    best = state.groupBy("container_kind", "shard").agg(F.min_by("elite", F.struct("score", "island")).alias("elite"))
    wide = groups.join(best, ["container_kind", "shard"]).select("container_kind", "shard", "capacity", F.explode(F.arrays_zip("items", F.col("elite").alias("bin"))).alias("z"))
    rows = wide.select("container_kind", "capacity", "shard", "z.items.*", F.col("z.bin").alias("bin"))
    name = F.concat_ws("-", F.lit(f"l{level}"), "shard", "bin")
    if last:
        return rows.withColumn("container_id", name).withColumn("pooled", F.lit(False)).drop("shard", "bin")
    fill = rows.groupBy("container_kind", "shard", "bin").agg(F.sum("size").alias("filled"))
    ranked = fill.groupBy("container_kind", "shard").agg(F.array_sort(F.collect_list(F.struct("filled", "bin"))).alias("all"))
    worst = F.slice("all", F.lit(1), F.greatest(F.ceil(F.size("all") * POOLED).cast("int"), F.lit(2)))  # as in pooled_bins
    pooled = ranked.select("container_kind", "shard", F.explode(worst).alias("w")).select("container_kind", "shard", "w.bin").withColumn("pooled", F.lit(True))
    out = rows.join(pooled, ["container_kind", "shard", "bin"], "left").withColumn("container_id", name)
    return shared_table(out.withColumn("pooled", F.coalesce("pooled", F.lit(False))).drop("shard", "bin"), "p8-packed")


def _turn(todo: DataFrame, turn: int, last: bool, islands: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for kind, shard, island, capacity, sizes, elites in zip(pdf["container_kind"], pdf["shard"], pdf["island"], pdf["capacity"], pdf["sizes"], pdf["elites"], strict=True):
                sizes, capacity = [int(s) for s in sizes], int(capacity)
                elite, done = evolve(sizes, capacity, [list(map(int, e)) for e in elites], seed=1_000_003 * turn + 1_009 * int(shard) + int(island), last=last)
                made = _from_list(elite, sizes, capacity)
                out.append((kind, 0, shard, island, elite, done, len(made.bins) if last else made.wasted()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _STATE.split(", ")])

    # islands are few rows and long work: a number of partitions of their own, which adaptive execution does not merge
    tasks = todo.repartition(min(islands, TASKS_PER_CORE * todo.sparkSession.sparkContext.defaultParallelism), F.xxhash64("container_kind", "shard", "island"))
    return tasks.mapInPandas(run, _STATE)


def report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """container_kind, containers, least (the tokens' sum over the capacity), fill."""
    kinds = capacities.groupBy("container_kind").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    used = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("filled")).groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("filled").alias("tokens"))
    out = used.join(kinds, "container_kind")
    return out.select("container_kind", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
