"""Near-duplicate records with small edits: BagMinHash, banding, exact verification.

Texts with equal bags of word runs form one class, of which one text is compared. Candidates share a band of
their signatures. A band bucket above HOT_BUCKET texts is not paired: its texts are joined instead by the
prefixes of their bags in order of rarity, which no pair above the threshold can miss. Every candidate is
verified on the bags themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.bagminhash import bands, mix, signatures
from loomdex.sources.shared import discard, shared_table

ROWS = 4  # registers of a band
BANDS = 40  # a pair of similarity 0.7 shares none with probability (1 - 0.7**4)**40 = 0.00002
HOT_BUCKET = 64
EXPAND = 64  # up to so many equal texts come out as all their pairs, more of them as pairs with their first member
SALTED = 256  # members of a class that one task pairs with the others
WORDS_KEPT = 500_000

_WORD = re.compile(r"\w+")


class Bags:
    """Word runs of texts as hashes."""

    def __init__(self, run: int, counted: bool):
        self.run, self.counted, self.known = run, counted, {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Distinct hashes, ascending, their weights, and the number of words."""
        words = _WORD.findall(text.lower())
        if len(words) < self.run:
            return np.empty(0, np.uint64), np.empty(0), len(words)
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        ids = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            ids.append(h)
        h = np.array(ids, dtype=np.uint64)
        out = h[: len(h) - self.run + 1]
        for i in range(1, self.run):
            out = mix(out) + h[i : len(h) - self.run + 1 + i]
        found, n = np.unique(mix(out), return_counts=True)
        return found, (n.astype(np.float64) if self.counted else np.ones(len(found))), len(words)


def _sign(batches: Iterator[pd.DataFrame], run: int, min_words: int, counted: bool) -> Iterator[pd.DataFrame]:
    bags = Bags(run, counted)
    for pdf in batches:
        rows = []
        for doc, text in zip(pdf["id"], pdf["text"], strict=True):
            e, w, n = bags.of(text)
            if n >= min_words and len(e):
                rows.append((doc, e, w, xxhash.xxh64_intdigest(text) - 2**63))
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            sizes = np.array([len(r[1]) for r in part])
            e, w = np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part])
            keys = bands(signatures(e, w, np.repeat(np.arange(len(part)), sizes), len(part), ROWS * BANDS), ROWS)
            out = []
            for i, (doc, own, weights, body) in enumerate(part):
                if counted:  # the j-th occurrence of a run is an element of its own, so that bags compare as sets
                    n = weights.astype(np.int64)
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own = np.unique(mix(np.repeat(own, n) + nth.astype(np.uint64)))
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                out.append((doc, body, digest, len(own), (own >> np.uint64(32)).astype(np.uint32).view(np.int32), keys[i]))
            yield pd.DataFrame(out, columns=["id", "body", "digest", "n", "bag", "keys"])


class NearDuplicates:
    """classes: id, digest, body (hash of the text itself), rep (first id of the digest), size and head (number and first
    id of the equal texts), alone (the only row of its digest). links: a, b, similarity of representatives, a < b."""

    def __init__(self, classes: DataFrame, links: DataFrame):
        self.classes, self.links = classes, links


def near_duplicates(rows: DataFrame, id_column: str, text_column: str, run: int = 5, threshold: float = 0.8, min_words: int = 20, counted: bool = True) -> NearDuplicates:
    """Texts of at least `min_words` words whose bags of `run` consecutive words have (weighted) Jaccard similarity >= threshold.

    Words are runs of letters, digits and underscores, in lower case. `counted` weighs a run by its
    occurrences, else every distinct run weighs 1. Rows with NULL id or text, and shorter texts, take no part.
    Repeated rows count once; if an id has several texts, each is compared and the id belongs to each. Other
    columns are ignored; an empty table gives empty results. Bags are compared by 32 bits of each run's hash.
    """
    texts = rows.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).where("id is not null and text is not null")
    schema = "id string, body bigint, digest binary, n int, bag array<int>, keys array<bigint>"
    signed = texts.mapInPandas(lambda it: _sign(it, run, min_words, counted), schema)
    signed = shared_table(signed.withColumn("uid", F.monotonically_increasing_id()), "p6-signed")
    # the row that stands for a digest; the others are few, or many copies of few
    first = signed.groupBy("digest").agg(F.min(F.struct("id", "uid")).alias("first"), F.count("*").alias("rows"))
    repeated = shared_table(first.where("rows > 1").select("digest", F.col("first.id").alias("rep"), F.col("first.uid").alias("rep_uid")), "p6-repeated")
    members = shared_table(signed.select("id", "body", "digest", "uid").join(repeated, "digest"), "p6-members")
    docs = signed.join(members.where("uid != rep_uid").select("uid"), "uid", "left_anti")

    pairs = _candidates(docs, threshold)
    links = _verify(pairs, docs, threshold)
    copies = members.select("id", "digest", "body", "rep").distinct()
    sized = copies.groupBy("digest", "body").agg(F.count("*").alias("size"), F.min("id").alias("head"))
    alone = docs.join(repeated, "digest", "left_anti").select("id", "digest", "body", F.col("id").alias("rep"), F.lit(1).cast("long").alias("size"), F.col("id").alias("head"), F.lit(True).alias("alone"))
    classes = copies.join(sized, ["digest", "body"]).select("id", "digest", "body", "rep", "size", "head", F.lit(False).alias("alone")).unionByName(alone)
    return NearDuplicates(classes, links)


def _candidates(docs: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs of uids (a < b) that may reach the threshold."""
    buckets = docs.select("uid", "n", F.explode("keys").alias("key"))
    sizes = shared_table(buckets.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "p6-buckets")
    held = shared_table(buckets.join(sizes, "key"), "p6-held")
    cold = _self_join(held.where(F.col("held") <= HOT_BUCKET), threshold)
    hot = held.where(F.col("held") > HOT_BUCKET).select("uid").distinct()
    return cold.unionByName(_self_join(_prefixes(docs.join(hot, "uid", "left_semi"), threshold), threshold)).distinct()


def _self_join(keyed: DataFrame, threshold: float) -> DataFrame:
    a = keyed.select("key", F.col("uid").alias("a"), F.col("n").alias("na"))
    b = keyed.select("key", F.col("uid").alias("b"), F.col("n").alias("nb"))
    like = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    return a.join(b, "key").where((F.col("a") < F.col("b")) & like).select("a", "b")


def _prefixes(docs: DataFrame, threshold: float) -> DataFrame:
    """key, uid, n: the rarest n - ceil(threshold * n) + 1 elements of each bag; bags of a pair share one of these."""
    elements = docs.select("uid", "n", F.explode("bag").alias("element"))
    rarity = elements.groupBy("element").agg(F.count("*").alias("df"))
    ordered = elements.join(rarity, "element").groupBy("uid").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "element"))).alias("bag"))
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    return ordered.select("uid", "n", F.explode(F.slice("bag", F.lit(1), length)).alias("e")).select(F.xxhash64("e.element").alias("key"), "uid", "n").distinct()


def _verify(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    left = docs.select(F.col("uid").alias("a"), F.col("id").alias("id_a"), F.col("bag").alias("bag_a"))
    right = docs.select(F.col("uid").alias("b"), F.col("id").alias("id_b"), F.col("bag").alias("bag_b"))
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", shared)
    similarity = F.col("shared") / (F.size("bag_a") + F.size("bag_b") - F.col("shared"))
    found = both.withColumn("similarity", similarity).where(F.col("similarity") >= threshold - 1e-12)
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity")


def pairs_of_ids(found: NearDuplicates) -> DataFrame:
    """id_a, id_b (a < b), once each. Of more than EXPAND equal texts the first id stands for the others, each of which
    comes out with it alone; texts that differ, if only in case or punctuation, come out in all their pairs."""
    classes = found.classes.where("not alone")
    shown = classes.where((F.col("size") <= EXPAND) | (F.col("id") == F.col("head"))).select("digest", "id", "rep").distinct()
    counts = shown.groupBy("digest").agg(F.ceil(F.count("*") / F.lit(SALTED)).cast("int").alias("salts"))
    salted = shown.join(counts, "digest")
    left = salted.select("digest", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("a"))
    right = salted.select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("b"))
    within = left.join(right, ["digest", "salt"]).where("a < b").select("a", "b")
    star = classes.where((F.col("size") > EXPAND) & (F.col("id") != F.col("head"))).select(F.col("head").alias("a"), F.col("id").alias("b"))
    copies = shown.where("id != rep").select("rep", "id").distinct()
    out = found.links.select("a", "b")
    for side in ("a", "b"):
        more = out.join(copies.withColumnRenamed("rep", side), side).drop(side).withColumnRenamed("id", side)
        out = out.unionByName(more.select("a", "b"))
    links = out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b")
    return links.unionByName(within).unionByName(star).distinct().toDF("id_a", "id_b")


def groups(found: NearDuplicates) -> DataFrame:
    """id, group_id (smallest id linked, through any number of links), links (of the class's representative).

    Labels fall to the least of the neighbours' and jump to the label's own label, so rounds grow as the logarithm
    of the longest chain; a round's table is removed once the next is written.
    """
    edges = shared_table(found.links.select("a", "b").unionByName(found.links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "p6-edges")
    labels = edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    settled = False
    before = None
    while not settled:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = shared_table(step.join(jump, "to", "left").select("node", F.least("to", "far").alias("label"), "was"), "p6-labels")
        labels, settled = new.select("node", "label"), new.where("label != was").isEmpty()
        if before is not None:
            discard(before)
        before = new
    degree = edges.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    out = found.classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.groupBy("id").agg(F.min(F.coalesce("label", "rep")).alias("group_id"), F.max(F.coalesce("links", F.lit(0))).alias("links"))
