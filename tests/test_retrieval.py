"""BM25 against the standard library's full-text index, fusion, nearest neighbours, evaluation, intervals, the rest."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex import config, service
from loomdex.operators import dense, evaluate, fusion, intervals, lexical, stats
from loomdex.operators.search import Index, clamp_limit
from loomdex.streaming import events as S


def test_bm25_equals_a_full_text_index(spark):
    rng = random.Random(4)
    vocabulary = ["result", "modifier", "CAFÉ", "the", "счёт", "счет", "x1", "page", "Path"]
    texts = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    texts += [("61", "result_modifier.php", "one"), ("62", "modifier result", "result"), ("63", "only result", "modifier only")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, a, b, tokenize = 'unicode61')")
    db.executemany("insert into t values (?, ?, ?)", texts)
    questions = [("q1", "result_modifier"), ("q2", "cafe счёт"), ("q3", "the page unknown"), ("q4", "modifier"), ("q5", "? a")]
    index = lexical.build_index(spark.createDataFrame(texts, "id string, a string, b string"), "id", ["a", "b"])
    got = {}
    for r in lexical.bm25(index, spark.createDataFrame(questions, "query_id string, query string"), None).collect():
        got.setdefault(r["query_id"], {})[r["id"]] = r["score"]
    for key, text in questions:
        terms = [w for w in text.replace("?", "").split() if len(w) >= 2]
        match = " OR ".join(f'"{w}"' for w in terms)
        want = dict(db.execute("select id, -bm25(t) from t where t match ?", (match,)).fetchall()) if terms else {}
        assert set(got.get(key, {})) == set(want), key
        for k, v in want.items():
            assert got[key][k] == pytest.approx(v, abs=1e-9)


def test_bm25_of_nothing(spark):
    index = lexical.build_index(spark.createDataFrame([], "id string, a string"), "id", ["a"])
    assert lexical.bm25(index, spark.createDataFrame([("q", "x y")], "query_id string, query string")).count() == 0


def leg(spark, ids):
    return spark.createDataFrame([(i, n + 1, 1.0 / (n + 1)) for n, i in enumerate(ids)], "id string, rank int, score double")


def test_fusion_order_and_shape(spark):
    out = fusion.fuse({"dense": leg(spark, ["a", "b", "c", ""]), "lexical": leg(spark, ["d", "b", "e"])}).orderBy("rank").collect()
    assert [r["id"] for r in out] == ["b", "a", "d", "c", "e"]
    assert out[0]["score"] == pytest.approx(2 / 62) and (out[0]["dense_rank"], out[0]["lexical_rank"]) == (2, 2)
    assert (out[1]["dense_rank"], out[1]["lexical_rank"], out[1]["lexical_score"]) == (1, None, None)


def test_fusion_of_repeated_and_no_rows(spark):
    twice = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 0.2), (None, 2, 0.5)], "id string, rank int, score double")
    (r,) = fusion.fuse({"x": twice}).collect()
    assert r["score"] == pytest.approx(1 / 61 + 1 / 63) and r["x_rank"] == 3
    assert fusion.fuse({"x": twice.limit(0)}, limit=0).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_nearest_equals_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [])], "id int, vector array<float>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 7)] + [(8, None)], "query_id int, vector array<float>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in dense.nearest(points, queries, 5, metric).collect()}
    for q in (0, 7):
        a, b = x[q].astype(np.float32), x.astype(np.float32)
        s = {"cosine": -(b @ a) / np.linalg.norm(b, axis=1), "dot": -(b @ a), "l2": np.linalg.norm(b - a, axis=1)}[metric]
        assert [got[q, n + 1] for n in range(5)] == list(np.argsort(s)[:5])
    assert dense.nearest(points.limit(0), queries, 5).count() == 0
    assert dense.nearest(points, queries.limit(0), 5).count() == 0


def test_many_queries_go_in_passes(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id int, vector array<float>")
    queries = points.withColumnRenamed("id", "query_id")
    once = sorted(map(tuple, dense.nearest(points, queries, 3).collect()))
    monkeypatch.setattr(dense, "QUERY_BYTES", 200)
    assert sorted(map(tuple, dense.nearest(points, queries, 3).collect())) == once
    assert dense.vector_size(dense.hashing_embedder(7)) == 7


def test_embedding_is_remembered(spark):
    calls = spark.sparkContext.accumulator(0)
    base = dense.hashing_embedder(4)

    def embed(texts):
        calls.add(len(texts))
        return base(texts)

    texts = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", None)], "id string, text string")
    cache = spark.createDataFrame([], "model_name string, text_hash string, dim int, vector array<float>")
    out, new = dense.embed_cached(texts, cache, "m", embed, "p: ")
    assert new.count() == 3 and calls.value == 3 and out.where("vector is null").count() == 0
    assert dense.embed_cached(texts, new, "m", embed, "p: ")[1].count() == 0
    assert tuple(dense.cache_statistics(texts, new.where("false"), "m", "p: ").head()) == (1, 3)
    assert tuple(dense.cache_statistics(texts, new, "other", "p: ").head()) == (1, 3)


def test_evaluation(spark):
    lists = ", ".join(f"{n}: array<string>" for n in evaluate.LISTS)
    schema = f"case_id string, query string, case_group string, max_results int, filters struct<source: string, lang: string, path: string, source_type: string>, expected struct<{lists}>"
    none = (None,) * 6
    cases = evaluate.normalised_cases(spark.createDataFrame([("php_a_1", "q", "g", 0, (None, "JS", None, None), (["B.PHP"], None, None, None, None, None)), ("x_2", None, None, 1, None, (None, None, ["zzz"], None, ["word"], None)), ("none", "q", " ", None, None, none), (None, "q", None, None, None, none)], schema))
    results = spark.createDataFrame([("php_a_1", 1, "a.php", "t"), ("php_a_1", 2, "b.php", "t"), ("x_2", 1, "zzz", "word"), ("x_2", 2, "ok", "Word")], "case_id string, rank int, path string, text string")
    rows = {r["case_id"]: r for r in evaluate.evaluate(cases, results).collect()}
    assert (rows["php_a_1"]["first_rank"], rows["php_a_1"]["path_rank"], rows["php_a_1"]["filter_lang"], rows["php_a_1"]["id_prefix"]) == (2, 2, "javascript", "php_a")
    assert rows["x_2"]["first_rank"] is None and rows["none"]["hit_at_10"] is False and rows["none"]["group"] == "ungrouped"
    judged = evaluate.evaluate(cases, results)
    assert evaluate.totals(judged).head()["hit_at_10"] == 1
    by = {(r["dimension"], r["value"]): r["total"] for r in evaluate.summaries(judged).collect()}
    assert by["group", "ungrouped"] == 2 and by["filter_lang", "unknown"] == 2 and by["id_prefix", "php_a"] == 1
    empty = evaluate.totals(judged.where("false")).head()
    assert empty["total"] == 0 and empty["hit_at_5_rate"] == 0.0


def test_intervals(spark):
    r = spark.createDataFrame([("k", 2, 3), ("k", 4, 5), ("k", 3, 9), ("k", 12, 11), ("k", 20, 20), ("k", None, 3)], "k string, start int, end int")
    merged = sorted((x["start"], x["end"]) for x in intervals.merge_ranges(r, ["k"]).collect())
    assert merged == [(2, 9), (20, 20)]
    totals = spark.createDataFrame([("k", 25), ("other", 3)], "k string, total int")
    assert sorted((x["k"], x["start"], x["end"]) for x in intervals.gaps(r, totals, ["k"]).collect()) == [("k", 1, 1), ("k", 10, 19), ("k", 21, 25), ("other", 1, 3)]
    points = spark.createDataFrame([("k", 1, "p"), ("k", 5, "q")], "k string, line int, tag string")
    marks = spark.createDataFrame([("k", 5, 1, "type"), ("k", 5, 2, "function"), ("z", 1, 1, "no")], "k string, line int, position int, name string")
    assert sorted((x["tag"], x["name"]) for x in intervals.nearest_before(points, marks, ["k"], "name").collect()) == [("p", None), ("q", "function")]


def test_statistics(spark):
    rows = spark.createDataFrame([("indexed", 1048576, 2), ("indexed", 0, 4), ("too_large", 10, None)], "outcome string, size_bytes long, chunk_count int")
    r = stats.index_statistics(rows).head()
    assert (r["scanned"], r["indexed"], r["chunks"], r["average_chunks"], r["most_chunks"]) == (3, 2, 6, 3.0, 4)
    assert stats.index_statistics(rows.limit(0)).head()["chunks"] == 0


def test_event_windows_with_a_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 01:00:00", 1, "a", 2.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = S.tumbling(S.with_event_time(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")), lateness="1 hour")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").count() == 1


def test_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv("PLACE", "here")
    (tmp_path / "a.yaml").write_text("root: $PLACE/x\nother: $NOT_SET_AT_ALL\nlist: [$PLACE]\n")
    assert config.load_yaml(tmp_path / "a.yaml") == {"root": "here/x", "other": "$NOT_SET_AT_ALL", "list": ["here"]}
    (tmp_path / "b.yaml").write_text("")
    assert config.load_yaml(tmp_path / "b.yaml") == {}
    (tmp_path / "c.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        config.load_yaml(tmp_path / "c.yaml")
    with pytest.raises(FileNotFoundError):
        config.load_yaml(tmp_path / "none.yaml")
    s = config.Settings.from_environment({"LOOMDEX_DEFAULT_LIMIT": "7", "LOOMDEX_MAX_LIMIT": "15", "LOOMDEX_MAX_TEXT_CHARS": "1234"})
    assert (s.default_limit, s.max_limit, s.max_text_chars) == (7, 15, 1234)
    assert [clamp_limit(x) for x in (None, 0, -3, 9, 99)] == [5, 5, 1, 9, 20]


def test_derived_experiment(tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "embeddings.yaml").write_text("model: a\nproviders: [cpu]\n")
    (tmp_path / "c" / "store.yaml").write_text("collection: base\n")
    config.derive_experiment(tmp_path / "c", tmp_path / "e", "one", {"embeddings": {"cuda": True}, "store": {"collection": "one"}})
    assert config.load_yaml(tmp_path / "e/one/embeddings.yaml") == {"model": "a", "cuda": True}
    assert config.load_yaml(tmp_path / "c/store.yaml") == {"collection": "base"} and (tmp_path / "e/one/README.md").exists()
    with pytest.raises(FileExistsError):
        config.derive_experiment(tmp_path / "c", tmp_path / "e", "one", {})
    with pytest.raises(ValueError):
        config.derive_experiment(tmp_path / "c", tmp_path / "e", "../x", {})


def test_service(spark):
    chunks = spark.createDataFrame([("1", "s", "t", "php", "/a", "a", "find the cart", "find the cart")], "chunk_id string, source_name string, source_type string, language string, path string, rel_path string, text string, text_for_embedding string")
    s = service.SearchService(config.Settings.from_environment({"LOOMDEX_MODE": "sparse"}), lambda: Index(chunks))
    assert s.ready()[0] == 503 and s.health()[0] == 200
    s.start()
    assert s.ready()[0] == 200
    answer = s.search("cart", limit=0, lang="PHP")
    assert answer["count"] == 0 or answer["results"][0]["id"] == "1"
    assert answer["limit"] == 5 and answer["filters"]["lang"] == "php"
    with pytest.raises(ValueError):
        s.search("x", mode="lexical")
    broken = service.SearchService(config.Settings.from_environment({}), lambda: 1 / 0)
    broken.start()
    assert broken.ready()[1]["error"] == "division by zero"
