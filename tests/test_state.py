"""Manifest, incremental processing, versions, the index as a whole."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomdex.operators import manifest as M
from loomdex.operators.dense import hashing_embedder
from loomdex.operators.incremental import files_to_process, pending, run_incremental
from loomdex.operators.indexing import IndexStore, index_source, open_index, prune
from loomdex.operators.search import MODES, one_query, respond, search
from loomdex.operators.filters import Scope
from loomdex.sources.files import scan_folder
from loomdex.sources.versions import VersionedTable
from loomdex.streaming.events import stream_index

FILE = "source_name string, path string, rel_path string, language string, size_bytes long, text string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_pending_takes_nulls_as_equal_and_ignores_other_columns(spark):
    source = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), (None, None, "x"), ("c", None, "x")], "k string, v string, extra string")
    target = spark.createDataFrame([("a", "1", 5), ("b", "1", 5), (None, None, 5)], "k string, v string, extra int")
    assert rows(pending(source, target, ["k"], "v"), "k", "v") == [("b", "2"), ("c", None)]
    assert pending(source, target.limit(0), ["k"], "v").count() == 4


def test_runs_process_each_record_once(spark, tmp_path):
    target = VersionedTable(spark, f"file://{tmp_path}/t")
    seen = []

    def make(todo):
        seen.append(sorted(r["k"] for r in todo.collect()))
        return todo.where("k != 'empty'").select("k", "v", F.upper("v").alias("out"))

    s1 = spark.createDataFrame([("a", "x"), ("b", "y"), ("empty", "z")], "k string, v string")
    assert run_incremental(s1, target, ["k"], "v", make) == 1
    assert run_incremental(s1, target, ["k"], "v", make) == 1  # nothing to do, nothing published
    s2 = spark.createDataFrame([("a", "x"), ("b", "new"), ("c", "w")], "k string, v string")

    def dies(todo):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run_incremental(s2, target, ["k"], "v", dies)
    assert target.version() == 1
    run_incremental(s2, target, ["k"], "v", make)
    assert seen == [["a", "b", "empty"], ["b", "c"]]
    assert rows(target.read(), "k", "out") == [("a", "X"), ("b", "NEW"), ("c", "W")]


def test_a_version_published_meanwhile_is_refused(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    one = spark.range(1)
    assert table.version() == 0 and table.read() is None
    assert table.publish(one, expected=0) == 1
    with pytest.raises(RuntimeError):
        table.publish(one, expected=0)
    assert table.version() == 1 and table.publish(one) == 2


def folder_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_run_writes_what_changed(spark, tmp_path):
    target = VersionedTable(spark, f"file://{tmp_path}/t")
    make = lambda todo: todo.select("k", "v", F.sha2(F.concat("k", "v"), 512).alias("out"))
    source = lambda new: spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 100 == 0, new).otherwise("old").alias("v"))
    run_incremental(source("old"), target, ["k"], "v", make)
    before = folder_bytes(tmp_path)
    assert run_incremental(source("new").where("k is null or k != '7'"), target, ["k"], "v", make) == 2
    assert folder_bytes(tmp_path) - before < 0.05 * before
    after = target.read()
    assert after.count() == 19_999 and after.where("v = 'new'").count() == 200 and after.where("k is null").select("v").collect()[0][0] == "new" and after.where("k = '7'").isEmpty()
    assert target.read(1).count() == 20_000  # earlier versions stay readable
    assert target.compact() == 3 and len(target.log.snapshot()[target.NAME]) == 1 and target.compact() == 3
    assert sorted(map(tuple, target.read().collect()), key=str) == sorted(map(tuple, after.collect()), key=str)
    assert target.log.vacuum(keep=1, older_than_seconds=0) == 3 and target.read().count() == 19_999


def test_of_two_writers_one_wins(spark, tmp_path):
    import threading

    target = VersionedTable(spark, f"file://{tmp_path}/t")
    target.publish(spark.range(1))
    won, lost = [], []
    begin = threading.Barrier(4)

    def write(n):
        rows = target.log.rows(spark.range(n))
        begin.wait()
        try:
            won.append((n, target.log.commit({target.NAME: [rows]}, 1)))
        except RuntimeError:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in (2, 3, 4, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and won[0][1] == 2 and len(lost) == 3 and target.read().count() == won[0][0]


def test_a_crash_between_write_and_commit_changes_nothing(spark, tmp_path, monkeypatch):
    target = VersionedTable(spark, f"file://{tmp_path}/t")
    target.publish(spark.createDataFrame([("a", "1")], "k string, v string"))
    source = spark.createDataFrame([("a", "2")], "k string, v string")
    with monkeypatch.context() as m:
        m.setattr(type(target.log), "_made", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run_incremental(source, target, ["k"], "v", lambda todo: todo)
    assert rows(target.read(), "k", "v") == [("a", "1")]
    assert run_incremental(source, target, ["k"], "v", lambda todo: todo) == 2 and rows(target.read(), "k", "v") == [("a", "2")]


def test_files_to_process(spark):
    t = lambda day: f"2031-01-0{day} 00:00:00"
    runs = spark.createDataFrame([(1, "s", "ok"), (2, "s", "failed"), (9, "s", "running")], "run_id int, source_name string, status string")
    indexed = spark.createDataFrame(
        [("s", "/r/./same", "AA", t(1), 1), ("s", "/r/failed", "aa", t(1), 2), ("s", "\\r\\changed", "aa", t(1), 1), ("s", "/r/back", "aa", t(2), 1), ("s", "/r/back", "bb", t(1), 1), ("s", None, "cc", t(1), 1), ("s", "/r/nullhash", None, t(1), 1)],
        "source_name string, path string, file_hash string, indexed_at string, run_id int",
    ).withColumn("indexed_at", F.col("indexed_at").cast("timestamp"))
    scans = spark.createDataFrame(
        [(1, 9, "s", "/r/same", "sha256:aa", t(1)), (2, 9, "s", "/r//failed", "aa", t(1)), (3, 9, "s", "/r/changed", "aa", t(1)), (4, 9, "s", "/r/changed", "bb", t(2)), (5, 9, "s", "/r/changed", None, t(3)), (6, 9, "s", "/r/back", "bb", t(1)), (7, 8, "s", "/r/old", "x", t(1)), (8, 9, "s", "/r/unread", None, t(1)), (9, 9, None, "/r/x", "y", t(1)), (10, 9, "s", "/r/nullhash", "aa", t(1)), (10, 9, "s", "/r/nullhash", "aa", t(1))],
        "scan_id long, run_id int, source_name string, path string, file_hash string, scanned_at string",
    ).withColumn("scanned_at", F.col("scanned_at").cast("timestamp"))
    assert rows(files_to_process(indexed, runs, scans, 9), "path") == [("/r/back",), ("/r/changed",), ("/r/failed",), ("/r/nullhash",)]
    assert files_to_process(indexed.limit(0), runs.limit(0), scans.limit(0), 9).count() == 0


def test_outcomes_and_replacement(spark):
    files = spark.createDataFrame([("s", "a", "a", "text", 1, "same"), ("s", "b", "b", "text", 1, "new"), ("s", "c", "c", "text", 1, " "), ("s", "d", "d", "text", 99, "big")], FILE)
    old = files.select("source_name", "path", M.file_hash().alias("file_hash")).where("path = 'a'").unionByName(spark.createDataFrame([("s", "b", "x"), ("s", "gone", "y")], "source_name string, path string, file_hash string"))
    assert rows(M.outcomes(files, old, 10), "path", "outcome") == [("a", "skipped"), ("b", "indexed"), ("c", "empty"), ("d", "too_large")]
    assert ("a", "indexed") in rows(M.outcomes(files, old, 10, force=True), "path", "outcome")
    assert rows(M.stale(old, files), "path") == [("gone",)]
    links = spark.createDataFrame([("s", "b", "1", 1), ("s", "a", "2", 1)], "source_name string, path string, chunk_id string, ordinal int")
    new = spark.createDataFrame([("s", "b", "7", 4), ("s", "b", "8", 9)], "source_name string, path string, chunk_id string, ordinal int")
    m, after, _ = M.replace_files(old.withColumn("chunk_count", F.lit(1)), links, links, files.where("path = 'b'").withColumn("file_hash", M.file_hash()), new)
    assert rows(after, "path", "chunk_id", "ordinal") == [("a", "2", 1), ("b", "7", 1), ("b", "8", 2)]
    assert rows(m.where("path = 'b'"), "chunk_count") == [(2,)]
    assert rows(M.stale_chunk_ids(links, after), "chunk_id") == [("1",)]


def test_index_search_prune(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "vendor").mkdir()
    (src / "a.php").write_text("<?php\n/** Sums the basket. */\nfunction total()\n{\n    return 1;\n}\n")
    (src / "sub" / "b.md").write_text("# Notes\nthe quick result_modifier walks\n")
    (src / "vendor" / "x.php").write_text("<?php\n")
    (src / "bad.txt").write_bytes(b"caf\xe9 words here")
    store, embed = IndexStore(spark, f"file://{tmp_path}/index"), hashing_embedder()
    scan = lambda: scan_folder(spark, "s", f"file://{src}", exclude=["vendor/"])
    assert rows(scan(), "rel_path") == [("a.php",), ("bad.txt",), ("sub/b.md",)]
    assert "�" in scan().where("rel_path = 'bad.txt'").head()["text"]
    assert open_index(store, "m", embed).chunks.count() == 0
    assert rows(index_source(store, scan(), "m", embed, dry_run=True), "outcome") == [("scanned",)] * 3
    index_source(store, scan(), "m", embed)
    assert rows(index_source(store, scan(), "m", embed), "outcome") == [("skipped",)] * 3
    index = open_index(store, "m", embed)
    for mode in MODES:
        found = search(index, one_query(spark, "basket total"), mode, 3)
        assert found.where("rank = 1").head()["rel_path"] == "a.php", mode
    with pytest.raises(ValueError):
        search(index, one_query(spark, "x"), "other")
    only = search(index, one_query(spark, "result_modifier"), "hybrid", 5, Scope(lang=" MD "))
    assert [r["rel_path"] for r in only.collect()] == ["sub/b.md"]
    answer = respond(only, max_text_chars=5).head()
    assert answer["count"] == 1 and answer["results"][0]["text"].endswith("<truncated>")
    (src / "a.php").unlink()
    (src / "sub" / "b.md").write_text("\n")
    assert prune(store, scan(), dry_run=True).head()["stale_files"] == 1
    prune(store, scan())
    index_source(store, scan(), "m", embed)
    assert rows(open_index(store, "m", embed).chunks, "rel_path") == [("bad.txt",)]


def test_files_that_stream_in_are_indexed_once(spark, tmp_path):
    store, embed = IndexStore(spark, f"file://{tmp_path}/index"), hashing_embedder()
    spark.createDataFrame([("s", "/a.md", "a.md", "markdown", 9, "# T\nwords")], FILE).write.parquet(f"{tmp_path}/in")
    for text in ("more", "more"):
        stream_index(spark, f"{tmp_path}/in", store, "m", embed, f"{tmp_path}/checkpoint").awaitTermination()
        spark.createDataFrame([("s", "/b.txt", "b.txt", "text", 4, text)], FILE).write.mode("append").parquet(f"{tmp_path}/in")
    assert rows(store.tables()["chunks"], "path") == [("/a.md",), ("/b.txt",)]


def test_all_links_of_kept_files_enter_the_merge(spark, tmp_path):
    from loomdex.plans import catalog

    def put(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    same = "b" * 10
    digest = spark.range(1).select(F.sha2(F.lit(same), 256)).head()[0]
    put("raw_files", [("s", "/kept", "kept", 10, same), ("s", "/new", "new", 1, "x")], "source_name string, path string, rel_path string, size_bytes long, text string")
    put("indexed_files", [("s", "/kept", digest, 6, datetime(2031, 1, 1))], "source_name string, path string, file_hash string, chunk_count int, indexed_at timestamp")
    links = [("s", "/kept", f"k{i}", i) for i in (1, 2, 3, 4, 6, 9)] + [("s", "/new", f"n{i}", i) for i in range(1, 6)]
    put("file_chunks", links, "source_name string, path string, chunk_id string, ordinal int")
    put("chunk_fts", [r[:3] for r in links], "source_name string, path string, chunk_id string")
    got = rows(catalog.QUERIES["manifest_merge"](spark, str(tmp_path)), "path", "chunk_count", "links", "last")
    assert got == [("/kept", 6, 6, 9), ("/new", 5, 5, 5)]


def test_failed_files_keep_their_state_and_stop_no_other(spark, tmp_path):
    from loomdex.operators.chunking import ChunkConfig
    from loomdex.operators.code import CodeConfig

    store, embed = IndexStore(spark, f"file://{tmp_path}/index"), hashing_embedder()
    files = lambda text: spark.createDataFrame([("s", "/a.php", "a.php", "php", 9, f"<?php\nfunction {text}() {{ }}\n"), ("s", "/b.txt", "b.txt", "text", 9, text)], FILE)
    assert rows(index_source(store, files("first"), "m", embed, metadata={"area": "core"}), "outcome") == [("indexed",), ("indexed",)]
    broken = {"php": CodeConfig(chunk=ChunkConfig(0, 0), fallback="none")}
    done = index_source(store, files("second"), "m", embed, configs=broken)
    assert rows(done, "path", "outcome") == [("/a.php", "failed"), ("/b.txt", "indexed")] and done.where("fault like 'ValueError%'").count() == 1
    kept = store.table("chunks").where("path = '/a.php' and symbol_name = 'first'").head()
    assert (kept["area"], kept["source"], kept["module"]) == ("core", "s", None) and store.table("chunks").where("path = '/b.txt'").head()["text"] == "second"
    with pytest.raises(RuntimeError):
        index_source(store, files("third"), "m", embed, configs=broken, stop_on_error=True)
    assert rows(index_source(store, files("second"), "m", embed), "path", "outcome") == [("/a.php", "indexed"), ("/b.txt", "skipped")]
    assert rows(store.paths("s"), "path") == [("/a.php",), ("/b.txt",)] and {r["table"] for r in store.describe().collect()} == set(store.tables())
    with pytest.raises(ValueError):
        open_index(store, "m", hashing_embedder(32))


def test_stored_postings_and_vectors_answer_as_computed_ones(spark, tmp_path):
    from loomdex.operators.search import Index

    store, embed = IndexStore(spark, f"file://{tmp_path}/index"), hashing_embedder()
    texts = ["the quick result_modifier walks", "quick quick notes on the basket", "result and modifier apart", "nothing here", "basket result_modifier result_modifier"]
    files = lambda n: spark.createDataFrame([("s", f"/{i}.txt", f"{i}.txt", "text", 9, t + (" changed basket" if i < n else "")) for i, t in enumerate(texts)], FILE)
    index_source(store, files(0), "m", embed)
    index_source(store, files(2), "m", embed)
    added = store.log.snapshot()["chunks"][-1]["rows"]
    assert spark.read.parquet(f"file://{tmp_path}/index/{added}").count() == 2
    def same(mode, q):
        opened = open_index(store, "m", embed)
        got, want = (rows(search(index, one_query(spark, q), mode, 3), "rank", "path", "score") for index in (opened, Index(opened.chunks, opened.vectors, embed)))
        return [(r, p, round(s, 9)) for r, p, s in got] == [(r, p, round(s, 9)) for r, p, s in want]

    assert same("lexical", "basket quick") and same("sparse", "result_modifier") and same("hybrid", "changed result_modifier") and same("sparse", "absent")
    store.compact()
    assert same("hybrid-fused", "basket result_modifier")


def test_service_over_http(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from loomdex.config import Settings
    from loomdex.service import SearchService, answer, serve

    store, embed = IndexStore(spark, f"file://{tmp_path}/index"), hashing_embedder()
    index_source(store, spark.createDataFrame([("s", "/a.php", "a.php", "php", 9, "<?php\nfunction basket() { return 1; }\n")], FILE), "m", embed)
    service, up = SearchService(Settings.from_environment({}), lambda: open_index(store, "m", embed)), threading.Event()
    assert answer(service, "/readyz")[0] == 503 and answer(service, "/search?query=x")[0] == 503 and answer(service, "/healthz")[0] == 200
    held = []
    thread = threading.Thread(target=serve, args=(service, "127.0.0.1", 0), kwargs={"started": lambda s: (held.append(s), up.set())}, daemon=True)
    thread.start()
    assert up.wait(120)
    base = f"http://127.0.0.1:{held[0].server_address[1]}"
    get = lambda path: json.load(urllib.request.urlopen(base + path, timeout=120))
    assert get("/readyz")["status"] == "ready" and get("/stats")["sources"] == 1
    found = get("/search?query=basket&mode=sparse&limit=1")
    assert found["count"] == 1 and found["results"][0]["symbol_name"] == "basket" and found["results"][0]["start_line"] == 2
    for path, status in (("/nowhere", 404), ("/search?query=x&mode=other", 400), ("/search", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path)
        assert e.value.code == status
    held[0].shutdown()
    thread.join(30)
