import random

import numpy as np
import pytest

from loomdex.llm import neardup as N
from loomdex.llm.bagminhash import signatures


def texts(seed=0, base=40, edits=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for b in range(base):
        original = [rng.choice(words) for _ in range(rng.randint(25, 90))]
        out.append((f"{b}-0", " ".join(original)))
        for e in range(1, edits):
            edited = list(original)
            for _ in range(rng.randint(1, 9)):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = rng.choice([[], [rng.choice(words)], [edited[at], rng.choice(words)]])
            out.append((f"{b}-{e}", " ".join(edited)))
    return out


def brute(rows, run, threshold, min_words=20):
    bags = {}
    for key, text in rows:
        w = text.lower().split()
        if len(w) >= min_words:
            bags[key] = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    keys = sorted(bags)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(bags[a] & bags[b]) / len(bags[a] | bags[b]) >= threshold}


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "id string, text string")
    return {tuple(r) for r in N.pairs_of_ids(N.near_duplicates(table, "id", "text", **options)).collect()}


def test_all_pairs_are_found(spark):
    rows = texts()
    rows += [("copy-a", rows[0][1]), ("copy-b", rows[0][1]), ("copy-b", rows[0][1])]
    want = brute(dict(rows).items(), 3, 0.7)
    assert want and found(spark, rows, run=3, threshold=0.7, counted=False) == want


def test_hot_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT_BUCKET", 1)
    rows = texts(seed=3, base=10, edits=6)
    assert found(spark, rows, run=3, threshold=0.7, counted=False) == brute(rows, 3, 0.7)


def test_large_classes_come_out_as_stars(spark, monkeypatch):
    monkeypatch.setattr(N, "EXPAND", 3)
    text = " ".join(f"a{i}" for i in range(30))
    got = found(spark, [(str(i), text) for i in range(6)], run=3, threshold=0.7)
    assert got == {("0", str(i)) for i in range(1, 6)}


def test_large_classes_of_different_texts_come_out_whole(spark, monkeypatch):
    monkeypatch.setattr(N, "EXPAND", 3)
    monkeypatch.setattr(N, "SALTED", 4, raising=False)
    words = [f"a{i}" for i in range(40)]
    rows = [(f"v{i}", " ".join(words[:i]) + "," * (i + 1) + " " + " ".join(words[i:])) for i in range(9)]
    rows += [(f"w{i}", " ".join(words).upper()) for i in range(5)]  # equal texts above the limit
    near = [("near", " ".join([*words[:-1], "other"])), ("near2", " ".join([*words[:-1], "Other"]) + ".")]
    got = found(spark, rows + near, run=3, threshold=0.7, counted=False)
    shown = sorted([f"v{i}" for i in range(9)] + ["w0", "near", "near2"])
    assert got == {(a, b) for i, a in enumerate(shown) for b in shown[i + 1 :]} | {("w0", f"w{i}") for i in range(1, 5)}


def test_groups(spark):
    rows = texts(seed=1, base=6, edits=4) + [("lonely", " ".join(f"q{i}" for i in range(40)))]
    r = N.near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text", run=3, threshold=0.7)
    groups = {x["id"]: (x["group_id"], x["links"]) for x in N.groups(r).collect()}
    assert groups["lonely"] == ("lonely", 0) and len(groups) == len(rows)
    for link in r.links.collect():
        assert groups[link["a"]][0] == groups[link["b"]][0]


def test_nulls_short_long_and_empty(spark):
    long = " ".join(f"x{i % 900}" for i in range(60_000))
    rows = [("1", None), (None, "a b"), ("2", ""), ("3", "few words only"), ("4", long), ("5", long + " end"), ("6", "ПРИВЕТ " * 30), ("7", "привет " * 31)]
    assert found(spark, rows, run=3, threshold=0.7, counted=False) == {("4", "5"), ("6", "7")}
    assert found(spark, rows, run=3, threshold=0.7, counted=True) >= {("4", "5")}
    empty = spark.createDataFrame([], "id string, text string, digest int")
    r = N.near_duplicates(empty, "id", "text")
    assert N.pairs_of_ids(r).count() == 0 and N.groups(r).count() == 0


@pytest.mark.parametrize("overlap", [0.2, 0.6, 0.9])
def test_signatures_estimate_weighted_jaccard_without_bias(overlap):
    rng = np.random.default_rng(int(overlap * 10))
    n, m, sets = 60, 64, 150
    elements, weights, owner, true = [], [], [], []
    for s in range(sets):
        e = rng.integers(1, 2**62, n).astype(np.uint64)
        w = rng.integers(1, 9, n).astype(float) * rng.choice([1.0, 0.5], n)
        keep = rng.random(n) < overlap
        v = np.where(keep, w, rng.integers(1, 9, n))
        elements += [e, e]
        weights += [w, v]
        owner += [np.full(n, 2 * s), np.full(n, 2 * s + 1)]
        true.append(np.minimum(w, v).sum() / np.maximum(w, v).sum())
    r = signatures(np.concatenate(elements), np.concatenate(weights), np.concatenate(owner), 2 * sets, m)
    same = (r[0::2] == r[1::2]).mean()
    assert abs(same - np.mean(true)) < 0.02
