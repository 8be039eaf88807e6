"""Command line: index, search, stats, eval, prune, derive."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import functions as F

from loomdex import config
from loomdex.operators import dense, evaluate, search
from loomdex.operators.filters import Scope
from loomdex.operators.indexing import IndexStore, index_source, open_index, prune
from loomdex.operators.stats import Timings, collection_statistics, index_statistics
from loomdex.session import local_session
from loomdex.sources.files import scan_folder

def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomdex", description=__doc__)
    p.add_argument("--index", default="index", help="folder of the index")
    p.add_argument("--config-dir", default="configs")
    p.add_argument("--profile", default="mvp")
    sub = p.add_subparsers(dest="verb", required=True)
    for name in ("index", "prune"):
        v = sub.add_parser(name)
        v.add_argument("--source", required=name == "prune", help="one source of sources.yaml")
        v.add_argument("--dry-run", action="store_true")
        if name == "index":
            v.add_argument("--force", action="store_true")
            v.add_argument("--max-files", type=int)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=5)
    s.add_argument("--source")
    s.add_argument("--lang")
    s.add_argument("--path")
    s.add_argument("--score-threshold", type=float)
    s.add_argument("--mode", choices=search.MODES)
    s.add_argument("--debug", action="store_true", help="ranks and scores of the legs")
    sub.add_parser("stats")
    sub.add_parser("compact", help="join what runs have added into one segment a table")
    f = sub.add_parser("files", help="the indexed paths of a source")
    f.add_argument("source")
    w = sub.add_parser("serve", help="search, stats and health over HTTP, as JSON")
    w.add_argument("--host", default="127.0.0.1")
    w.add_argument("--port", type=int, default=8000)
    e = sub.add_parser("eval")
    e.add_argument("--file")
    e.add_argument("--limit", type=int, default=10)
    e.add_argument("--mode", choices=search.MODES)
    d = sub.add_parser("derive", help="an experiment's configuration")
    d.add_argument("name")
    d.add_argument("--to", default="experiments")
    d.add_argument("--set", action="append", default=[], metavar="FILE.KEY=JSON")
    for option in ("model", "collection", "query-prefix", "document-prefix", "cache-path", "model-cache-dir"):
        d.add_argument(f"--{option}")
    d.add_argument("--provider", action="append")
    d.add_argument("--device-id", action="append", type=int)
    for option in ("parallel", "onnx-log-severity"):
        d.add_argument(f"--{option}", type=int)
    for option in ("local-files-only", "cuda", "preload-cuda-dependencies"):
        d.add_argument(f"--{option}", action=argparse.BooleanOptionalAction)
    d.add_argument("--force", action="store_true")
    return p


def sources(project: config.Project, name: str | None) -> list[dict]:
    found = [s for s in project.sources if name in (None, s["name"])]
    if not found:
        raise SystemExit(f"no source {name!r}")
    return found


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.verb == "derive":
        overrides = config.experiment_overrides(vars(a))
        for item in a.set:
            key, _, value = item.partition("=")
            stem, _, field = key.partition(".")
            overrides.setdefault(stem, {})[field] = json.loads(value)
        for path in config.derive_experiment(a.config_dir, a.to, a.name, overrides, a.force):
            print(path)
        return
    project = config.Project.load(a.config_dir, a.profile)
    e, limits = project.embedding, project.limits
    spark = local_session()
    store, embed = IndexStore(spark, str(Path(a.index).resolve())), dense.embedder(e.provider, e.model, e.batch_size)
    if a.verb == "files":
        for r in store.paths(a.source).toLocalIterator():
            print(r["path"])
        return
    if a.verb == "compact":
        print(store.compact())
        return
    if a.verb in ("index", "prune"):
        for s in sources(project, a.source):
            files = scan_folder(spark, s["name"], str(Path(s["root"]).expanduser().resolve()), s.get("include"), s.get("exclude"), getattr(a, "max_files", None))
            if a.verb == "prune":
                prune(store, files, a.dry_run).show(truncate=False)
            else:
                spent = Timings()
                done = index_source(
                    store, files, e.model, embed, e.passage_prefix, limits.max_file_bytes, a.force, a.dry_run, s.get("type", "project"), project.chunking, limits.max_chunks_per_file, s.get("metadata"), limits.stop_on_error, spent, limits.max_memory_mb
                )
                index_statistics(done.join(store.table("manifest").select("source_name", "path", "chunk_count"), ["source_name", "path"], "left")).show(truncate=False)
                spent.table(spark).orderBy("position", "bucket").show(truncate=False)
                done.where("fault is not null").select("path", "fault").show(20, truncate=False)
        return
    opened = lambda: open_index(store, e.model, embed, e.passage_prefix, e.query_prefix)
    if a.verb == "serve":
        from loomdex.service import SearchService, serve

        serve(SearchService(config.Settings.from_environment(), opened), a.host, a.port)
        return
    index = opened()
    mode = getattr(a, "mode", None) or project.mode
    if a.verb == "stats":
        collection_statistics(index.chunks).show(truncate=False)
    elif a.verb == "search":
        found = search.search(index, search.one_query(spark, a.query), mode, a.limit, Scope(source=a.source, lang=a.lang, path=a.path), a.score_threshold, project.ranking)
        for r in search.title(found).orderBy("rank").collect():
            told = "".join(f"{c}={r[c]} " for c in found.columns if a.debug and c.startswith(("dense_", "lexical_", "sparse_")))
            print(f"{r['rank']}. {r['title']}\n{told}\n{r['text'][:1200]}\n")
    else:
        cases = config.load_yaml(config.resolve_eval_file("eval", a.profile, a.file)).get("queries", [])
        lists = ", ".join(f"{n}: array<string>" for n in evaluate.LISTS)
        schema = f"case_id string, query string, case_group string, max_results int, filters struct<source: string, lang: string, path: string, source_type: string>, expected struct<{lists}>"
        rows = [(c["id"], c["query"], c.get("group"), c.get("limit", a.limit), {k: (c.get("filters") or {}).get(k) for k in ("source", "lang", "path", "source_type")}, {n: (c.get("expected") or {}).get(n) for n in evaluate.LISTS}) for c in cases]
        normal = evaluate.normalised_cases(spark.createDataFrame(rows, schema))
        found = search.search(index, normal.select(F.col("case_id").alias("query_id"), "query"), mode, a.limit, ranking=project.ranking)
        judged = evaluate.evaluate(normal, found.select(F.col("query_id").alias("case_id"), "rank", F.col("rel_path").alias("path"), "text"))
        evaluate.totals(judged).show()
        evaluate.summaries(judged).orderBy("dimension", "value").show(200, truncate=False)
        evaluate.failed(judged).select("case_id", "query", "top_paths").show(200, truncate=60)


if __name__ == "__main__":
    main()
