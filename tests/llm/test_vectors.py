import numpy as np
import pytest

from loomdex.llm import vectors as V

SCHEMA = "model_name string, text_hash string, dim int, vector array<float>, created_at timestamp, cosine string"


def table(spark, rows):
    from pyspark.sql import functions as F

    rows = [(m, h, d, None if v is None else [None if x is None else float(x) for x in v], t, "clash") for m, h, d, v, t in rows]
    return spark.createDataFrame(rows, SCHEMA.replace("created_at timestamp", "created_at string")).withColumn("created_at", F.col("created_at").cast("timestamp"))


def clustered(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * 0.15
    return x * rng.uniform(0.2, 3, size=(n, 1))


def test_neighbours_equal_brute_force_in_tiles():
    x = clustered(400).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    home = np.arange(400) % 3
    q, b, s = V.tile_join(x, np.arange(400), home, [np.array([0, 1, 2])] * 400, 5, tile=64)
    full = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(full, -9)
    want = np.sort(full, axis=1)[:, ::-1][:, :5]
    got = np.full((400, 5), -9.0)
    for row in range(400):
        got[row] = s[q == row]
    assert np.allclose(got, want)


def test_the_bound_holds():
    x = clustered(200, seed=5).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, error = V.int8_codes(x)
    about = (codes @ codes.T) * scale[:, None] * scale[None, :]
    slack = error[:, None] * (1 + error[None, :]) + (1 + error[:, None]) * error[None, :] + 1e-5
    assert (np.abs(x @ x.T - about) <= slack).all()


def test_recall_against_brute_force(spark):
    x = clustered(1500, seed=2)
    rows = [("m", f"{i:04}", 24, v, "2031-01-01 00:00:00") for i, v in enumerate(x)]
    found = V.similar_vectors(table(spark, rows), block_rows=300).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    want = {(f"{i:04}", f"{j:04}") for i in range(1500) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.8}
    got = {(r["text_hash"], r["neighbour_hash"]) for r in found}
    assert len(want & got) / len(want) >= 0.97
    assert {r["rank"] for r in found} == {1, 2, 3, 4, 5}


def test_newest_usable_copies_and_nulls(spark):
    a, b = [1.0, 0.0, 0.2], [0.9, 0.1, 0.2]
    new, old = "2031-02-01 00:00:00", "2031-01-01 00:00:00"
    rows = [("m", "a", 3, a, old), ("m", "a", 3, a, old), ("m", "b", 3, b, new), ("m", "b", 3, [0, 0, 1], old), ("m", "gone", 3, a, old), ("m", "gone", 3, [0, 0, 0], new)]
    rows += [("m", f"copy{i}", 3, [2 * x for x in a], None) for i in range(8)]
    rows += [("m", "nan", 3, [float("nan"), 1, 1], old), ("m", "inf", 3, [float("inf"), 1, 1], old), ("m", "short", 3, [1, 1], old), ("m", "null", 3, [None, 1, 1], old), ("m", "none", 3, None, old), (None, "x", 3, a, old), ("m", None, 3, a, old)]
    rows += [("other", "far", 3, a, old), ("m", "wide", 4, [1, 0, 0, 0], old)]
    found = {}
    for r in V.similar_vectors(table(spark, rows)).collect():
        found.setdefault((r["model_name"], r["text_hash"]), []).append((r["rank"], r["neighbour_hash"]))
    names = {h for _, h in found}
    assert names == {"a", "b", *[f"copy{i}" for i in range(8)]}
    assert [h for _, h in sorted(found["m", "a"])] == [f"copy{i}" for i in range(5)]
    assert [h for _, h in sorted(found["m", "copy0"])] == ["a", "copy1", "copy2", "copy3", "copy4"]
    assert [h for _, h in sorted(found["m", "b"])] == ["a", "copy0", "copy1", "copy2", "copy3"]


def test_empty_table(spark):
    assert V.similar_vectors(table(spark, []).where("false")).count() == 0


@pytest.mark.parametrize("dim", [3, 1500])
def test_long_and_large_vectors(spark, dim):
    rows = [("m", str(i), dim, np.full(dim, 3e37) * (1 + i * (np.arange(dim) % 2)) / 4, None) for i in range(3)]
    assert V.similar_vectors(table(spark, rows), k=2).count() == 6


@pytest.mark.parametrize("block_rows,query_rows", [(20_000, 160_000), (60, 50), (2_000, 70)])
def test_a_hot_cell_in_blocks_of_rows_and_queries_is_exact_with_all_cells(spark, block_rows, query_rows):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=24) + rng.normal(size=(400, 24)) * 0.2  # two thirds of all rows lie in one direction
    x = np.concatenate([hot, rng.normal(size=(200, 24))])
    rows = [("m", f"{i:04}", 24, v, None) for i, v in enumerate(x)]
    found = V.similar_vectors(table(spark, rows), probes=V.MAX_CELLS, block_rows=block_rows, query_rows=query_rows).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    assert {(r["text_hash"], r["neighbour_hash"]) for r in found} == {(f"{i:04}", f"{j:04}") for i in range(600) for j in np.argsort(-s[i])[:5]}
