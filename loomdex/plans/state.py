"""Queries of the manifest, intervals, evaluation, statistics and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.operators import evaluate as E
from loomdex.operators import intervals, lexical, manifest, stats
from loomdex.operators.dense import hashing_embedder
from loomdex.operators.indexing import IndexStore, index_source
from loomdex.plans.tables import table
from loomdex.sources.shared import shared_dir, shared_table
from loomdex.streaming import events as S

MAX_BYTES = 6000


def _files(spark, folder):
    return table(spark, folder, "raw_files").select("source_name", "path", "rel_path", "size_bytes", "text")


def _manifest(spark, folder):
    """The newest row of each file, where its hash is known."""
    rows = table(spark, folder, "indexed_files").where("file_hash is not null")
    return rows.groupBy("source_name", "path").agg(F.max(F.struct("indexed_at", "file_hash", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))).alias("m")).select("source_name", "path", "m.file_hash", "m.chunk_count", "m.indexed_at")


def manifest_changed(spark, folder):
    return manifest.changed(_files(spark, folder), _manifest(spark, folder)).select("source_name", "path")


def manifest_unchanged(spark, folder):
    files = _files(spark, folder).withColumn("file_hash", manifest.file_hash())
    return files.join(_manifest(spark, folder), ["source_name", "path", "file_hash"], "left_semi").select("source_name", "path")


def manifest_outcomes(spark, folder):
    return manifest.outcomes(_files(spark, folder), _manifest(spark, folder), MAX_BYTES).select("source_name", "path", "outcome")


def _links(spark, folder):
    return table(spark, folder, "file_chunks")


def manifest_merge(spark, folder):
    return _merged(spark, folder, _links(spark, folder))


def _merged(spark, folder, old_links):
    files = _files(spark, folder)
    todo = manifest.changed(files, _manifest(spark, folder))
    chunks = table(spark, folder, "chunk_fts").dropDuplicates(["chunk_id"])
    order = _links(spark, folder).groupBy("source_name", "path", "chunk_id").agg(F.min("ordinal").alias("ordinal"))
    new = chunks.select("source_name", "path", "chunk_id").join(order, ["source_name", "path", "chunk_id"]).join(todo.select("source_name", "path"), ["source_name", "path"], "left_semi")
    m, links, _ = manifest.replace_files(_manifest(spark, folder), old_links, chunks.select("source_name", "path", "chunk_id"), todo, new)
    held = links.groupBy("source_name", "path").agg(F.count("*").alias("links"), F.max("ordinal").cast("long").alias("last"))
    return m.select("source_name", "path", "file_hash", F.col("chunk_count").cast("long").alias("chunk_count")).join(held, ["source_name", "path"], "left")


def prune_stale(spark, folder):
    return manifest.stale(_manifest(spark, folder), _files(spark, folder)).select("source_name", "path")


def prune_dry_run(spark, folder):
    """As if the files of 2,000 bytes or less had gone from disk: the tables alone hold few stale files."""
    return manifest.prune_report(_manifest(spark, folder), _links(spark, folder), _files(spark, folder).where("size_bytes > 2000"))


def stale_chunk_ids(spark, folder):
    known = table(spark, folder, "chunk_fts").select("source_name", "path", "chunk_id")
    return manifest.stale_chunk_ids(known, _links(spark, folder))


def chunk_ids_by_file(spark, folder):
    return manifest.chunk_ids(_links(spark, folder)).select("source_name", "path", F.array_join("chunk_ids", ",").alias("ids"))


_KEYS = ["source_name", "path"]


def _ranges(spark, folder):
    s = table(spark, folder, "php_ast_symbol").where("kind in ('method', 'function')")
    return s.select(*_KEYS, F.col("start_line").alias("start"), F.col("end_line").alias("end"))


def range_merge(spark, folder):
    return intervals.merge_ranges(_ranges(spark, folder), _KEYS).select(*_KEYS, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def range_gaps(spark, folder):
    totals = table(spark, folder, "raw_files").where("lower(path) like '%.php'").select(*_KEYS, F.size(F.split("text", "\n")).alias("total"))
    return intervals.gaps(_ranges(spark, folder), totals, _KEYS).select(*_KEYS, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def asof_nearest(spark, folder):
    points = table(spark, folder, "php_doc_info").select(*_KEYS, F.col("start_line").alias("line")).distinct()
    marks = table(spark, folder, "php_ast_symbol").where("kind not in ('method', 'function')").select(*_KEYS, F.col("start_line").alias("line"), F.col("start_byte").alias("position"), "name").distinct()
    return intervals.nearest_before(points, marks, _KEYS, "name").select(*_KEYS, F.col("line").cast("long").alias("line"), "name")


def range_contain(spark, folder):
    docs = table(spark, folder, "php_doc_info").select(*_KEYS, F.col("start_line").alias("line")).distinct()
    types = table(spark, folder, "php_ast_symbol").where("kind not in ('method', 'function')").select(*_KEYS, F.col("start_line").alias("start"), F.col("end_line").alias("end"), "name").distinct()
    return intervals.contained(docs, types, _KEYS).select(*_KEYS, F.col("line").cast("long").alias("line"), "name")


def _evaluated(spark, folder):
    """Cases against results of BM25 over the chunks' embedding texts, all in one plan."""
    cases = E.normalised_cases(table(spark, folder, "eval_cases"))
    chunks = shared_table(table(spark, folder, "chunk_fts").dropDuplicates(["chunk_id"]), "chunks")
    index = lexical.build_index(chunks, "chunk_id", ["text_for_embedding"])
    hits = lexical.bm25(index, cases.select(F.col("case_id").alias("query_id"), "query"), 10)
    payload = chunks.select(F.col("chunk_id").alias("id"), F.col("rel_path").alias("path"), "text")
    return E.evaluate(cases, hits.join(payload, "id").select(F.col("query_id").alias("case_id"), "rank", "path", "text"))


def eval_rows(spark, folder):
    return _evaluated(spark, folder).select("case_id", "group", "id_prefix", "filter_lang", F.col("first_rank").cast("long").alias("first_rank"), F.col("path_rank").cast("long").alias("path_rank"), "hit_at_5", "hit_at_10", "path_hit_at_5", "path_hit_at_10")


def eval_totals(spark, folder):
    return E.totals(_evaluated(spark, folder))


def eval_by_group(spark, folder):
    return E.summaries(_evaluated(spark, folder))


def eval_failed(spark, folder):
    return E.failed(_evaluated(spark, folder)).select("case_id")


def eval_path_only(spark, folder):
    return _evaluated(spark, folder).where("path_rank is not null").select("case_id", F.col("path_rank").cast("long").alias("path_rank"))


def eval_top_paths(spark, folder):
    return _evaluated(spark, folder).select("case_id", F.array_join("top_paths", "|").alias("paths"))


def index_stats(spark, folder):
    judged = manifest.outcomes(_files(spark, folder), _manifest(spark, folder), MAX_BYTES)
    counts = table(spark, folder, "chunk_fts").groupBy(*_KEYS).agg(F.countDistinct("chunk_id").alias("chunk_count"))
    return stats.index_statistics(judged.join(counts, _KEYS, "left"))


def stage_timings(spark, folder):
    buckets = F.element_at(F.array(*[F.lit(b) for b in ("hash", "embed", "scan", "chunk", "other")]), (F.col("event_id") % 5 + 1).cast("int"))
    out = stats.stage_timings(table(spark, folder, "events").select(buckets.alias("bucket"), F.coalesce("value", F.lit(0.0)).alias("seconds")))
    return out.select("bucket", F.round("seconds", 4).alias("seconds"), F.col("position").cast("long").alias("position"))


def collection_stats(spark, folder):
    return stats.collection_statistics(table(spark, folder, "chunk_fts"))


def events_tumbling(spark, folder):
    out = S.tumbling(S.with_event_time(table(spark, folder, "events")))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


def events_sliding(spark, folder):
    out = S.sliding(S.with_event_time(table(spark, folder, "events")))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "events", "users")


def events_session(spark, folder):
    out = S.sessions(S.with_event_time(table(spark, folder, "events")))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "events")


def _indexed(store):
    """Of the index in force, by source: files, and chunks whose file, vector and terms are there too."""
    manifest_rows = store.table("manifest").groupBy("source_name").agg(F.countDistinct("path").alias("files"))
    chunks = store.table("chunks").select("chunk_id", "source_name").join(store.table("vectors").select(F.col("id").alias("chunk_id")), "chunk_id").join(store.table("lengths").select(F.col("id").alias("chunk_id")), "chunk_id")
    whole = chunks.groupBy("source_name").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids")).where("n = ids")
    return manifest_rows.join(whole, "source_name", "left_semi")


def _indexable(spark, folder):
    return table(spark, folder, "raw_files").select("source_name", "path", "rel_path", text.language_of(F.col("path")).alias("language"), "size_bytes", "text")


def _store(spark):
    return IndexStore(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")


def index_source_counts(spark, folder):
    """Every file scanned, cut, embedded, indexed by terms and published; then the same files again, which changes nothing."""
    store, files, embed = _store(spark), _indexable(spark, folder), hashing_embedder()
    index_source(store, files, "hashing-64", embed)
    index_source(store, files, "hashing-64", embed)
    return _indexed(store).where(F.lit(store.version() == 1))


def stream_index_counts(spark, folder):
    """The same files as they stream in, by micro-batches into an index; a second stream finds nothing new."""
    store, root = _store(spark), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _indexable(spark, folder).write.parquet(f"{root}/in")
    for _ in range(2):
        S.stream_index(spark, f"{root}/in", store, "hashing-64", hashing_embedder(), f"{root}/checkpoint").awaitTermination()
    return _indexed(store)


QUERIES = {f.__name__: f for f in (
    manifest_changed, manifest_unchanged, manifest_outcomes, manifest_merge, prune_stale, prune_dry_run, stale_chunk_ids, chunk_ids_by_file, range_merge, range_gaps, asof_nearest, range_contain,
    eval_rows, eval_totals, eval_by_group, eval_failed, eval_path_only, eval_top_paths, index_stats, stage_timings, collection_stats, events_tumbling, events_sliding, events_session, index_source_counts, stream_index_counts,
)}

_M = """m as (select source_name, path, arg_max(file_hash, (indexed_at, file_hash)) as file_hash, arg_max(coalesce(chunk_count, 0), (indexed_at, file_hash, coalesce(chunk_count, 0))) as chunk_count
    from indexed_files where file_hash is not null group by 1, 2)"""
_NEW = "f.source_name = m.source_name and f.path = m.path"
_R = "r as (select distinct source_name, path, start_line as s, end_line as e from php_ast_symbol where kind in ('method', 'function') and end_line >= start_line)"
_MERGED = f"""{_R}, n as (select *, case when s > max(e) over (partition by source_name, path order by s, e rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as fresh from r),
    i as (select *, sum(fresh) over (partition by source_name, path order by s, e rows unbounded preceding) as island from n),
    g as (select source_name, path, min(s) as s, max(e) as e from i group by source_name, path, island)"""


def _eval_sql(tail: str) -> str:
    terms = r"regexp_extract_all(translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), '[\p{{L}}\p{{N}}]+')"
    any_ = lambda h, n: f"(len(coalesce({n}, [])) = 0 or len(list_filter({n}, lambda x: contains(lower({h}), lower(x)))) > 0)"
    all_ = lambda h, n: f"len(list_filter(coalesce({n}, []), lambda x: not contains(lower({h}), lower(x)))) = 0"
    none = lambda h, n: f"len(list_filter(coalesce({n}, []), lambda x: contains(lower({h}), lower(x)))) = 0"
    path_ok = " and ".join([any_("path", "expected.path_contains_any"), all_("path", "expected.path_contains_all"), none("path", "expected.path_not_contains")])
    text_ok = " and ".join([any_("text", "expected.text_contains_any"), all_("text", "expected.text_contains_all"), none("text", "expected.text_not_contains")])
    size = lambda n: f"len(coalesce(expected.{n}, []))"
    path_asked = f"greatest({', '.join(size(n) for n in E.LISTS[:3])}) > 0"
    asked = f"greatest({', '.join(size(n) for n in E.LISTS)}) > 0"
    return f"""
        with t as (select chunk_id as id, any_value(text) as text, any_value(text_for_embedding) as body, any_value(rel_path) as path from chunk_fts group by chunk_id),
        w as materialized (select id, unnest(range(len(a))) as pos, unnest(a) as term, len(a) as length from (select id, {terms.format("coalesce(body, '')")} as a from t)),
        s as (select (select count(*) from t) as n, (select count(*) from w) / (select count(*) from t) as average), l as (select distinct id, length from w),
        q as (select distinct case_id, w from (select case_id, unnest(regexp_extract_all(lower(coalesce(query, '')), '[\\p{{L}}\\p{{N}}_]+')) as w from eval_cases) where length(w) >= 2),
        p as (select distinct case_id, {terms.format("w")} as terms from q),
        hits as (select case_id, terms, w.id, count(*) as tf from p join w on w.term = terms[1] where len(terms) = 1 group by all
            union all select case_id, terms, a.id, count(*) as tf from p join w a on a.term = terms[1] join w b on b.id = a.id and b.pos = a.pos + 1 and b.term = terms[2] where len(terms) = 2 group by all),
        df as (select case_id, terms, count(distinct id) as df from hits group by all),
        scored as (select case_id, id, sum((case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) as score
            from hits join df using (case_id, terms) join l using (id), s group by all),
        ranked as (select case_id, id, row_number() over (partition by case_id order by round(score, 9) desc, id) as rank from scored),
        res as (select c.case_id, rank, coalesce(path, '') as path, coalesce(text, '') as text, expected from eval_cases c join ranked using (case_id) join t using (id)
            where rank <= 10 and rank <= case when coalesce(max_results, 0) > 0 then max_results else 10 end),
        k as (select case_id, min(case when {asked} and {path_ok} and {text_ok} then rank end) as first_rank, min(case when {path_asked} and {path_ok} then rank end) as path_rank,
            string_agg(path, '|' order by rank) filter (rank <= 5) as paths from res group by case_id),
        e as (select case_id, coalesce(nullif(trim(case_group), ''), 'ungrouped') as "group",
            coalesce(nullif(case when string_split(case_id, '_')[1] = 'php' and len(string_split(case_id, '_')) > 1 then array_to_string(string_split(case_id, '_')[1:2], '_') else string_split(case_id, '_')[1] end, ''), 'unknown') as id_prefix,
            case lower(trim(filters.lang)) when 'js' then 'javascript' when 'jsx' then 'javascript' when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'md' then 'markdown' when 'yml' then 'yaml' when '' then null else lower(trim(filters.lang)) end as filter_lang,
            first_rank, path_rank, coalesce(first_rank <= 5, false) as hit_at_5, coalesce(first_rank <= 10, false) as hit_at_10, coalesce(path_rank <= 5, false) as path_hit_at_5, coalesce(path_rank <= 10, false) as path_hit_at_10, coalesce(paths, '') as paths
            from eval_cases left join k using (case_id) where case_id is not null)
        {tail}"""


_COUNTS = "count(*) as total, count_if(hit_at_5) as hit_at_5, count_if(hit_at_10) as hit_at_10, count_if(path_hit_at_5) as path_hit_at_5, count_if(path_hit_at_10) as path_hit_at_10"
_RATED = "total, hit_at_5::bigint as hit_at_5, hit_at_10::bigint as hit_at_10, path_hit_at_5::bigint as path_hit_at_5, path_hit_at_10::bigint as path_hit_at_10, hit_at_5 / total as hit_at_5_rate, hit_at_10 / total as hit_at_10_rate, path_hit_at_5 / total as path_hit_at_5_rate, path_hit_at_10 / total as path_hit_at_10_rate"

SQL = {
    "manifest_changed": f"with {_M} select source_name, path from raw_files f where not exists (select 1 from m where {_NEW} and m.file_hash = sha256(coalesce(f.text, '')))",
    "manifest_unchanged": f"with {_M} select source_name, path from raw_files f where exists (select 1 from m where {_NEW} and m.file_hash = sha256(coalesce(f.text, '')))",
    "manifest_outcomes": f"""with {_M} select source_name, path, case when size_bytes > {MAX_BYTES} then 'too_large' when exists (select 1 from m where {_NEW} and m.file_hash = sha256(coalesce(f.text, ''))) then 'skipped'
        when trim(coalesce(text, '')) = '' then 'empty' else 'indexed' end as outcome from raw_files f""",
    "manifest_merge": f"""with {_M}, todo as (select source_name, path, sha256(coalesce(text, '')) as h from raw_files f where not exists (select 1 from m where {_NEW} and m.file_hash = sha256(coalesce(f.text, '')))),
        new as (select distinct source_name, path, chunk_id from file_chunks where (source_name, path, chunk_id) in (select (source_name, path, chunk_id) from chunk_fts) and (source_name, path) in (select (source_name, path) from todo)),
        c as (select source_name, path, count(*) as n from new group by 1, 2),
        o as (select source_name, path, count(*) as links, max(ordinal) as last from file_chunks where (source_name, path) not in (select (source_name, path) from todo) group by 1, 2)
        select source_name, path, h as file_hash, coalesce(n, 0) as chunk_count, n as links, n as last from todo left join c using (source_name, path)
        union all select source_name, path, file_hash, chunk_count::bigint, links, last::bigint from m left join o using (source_name, path) where (source_name, path) not in (select (source_name, path) from todo)""",
    "prune_stale": f"with {_M} select source_name, path from m where source_name in (select source_name from raw_files) and not exists (select 1 from raw_files f where {_NEW})",
    "prune_dry_run": f"""with {_M}, f as (select * from raw_files where size_bytes > 2000), g as (select distinct source_name, path from m where not exists (select 1 from f where {_NEW})),
        c as (select g.source_name, count(distinct g.path) as stale_files, count(chunk_id) as stale_chunks from g left join (select distinct source_name, path, chunk_id from file_chunks) k using (source_name, path) group by 1)
        select source_name, coalesce(stale_files, 0) as stale_files, coalesce(stale_chunks, 0) as stale_chunks from (select distinct source_name from f) left join c using (source_name)""",
    "stale_chunk_ids": "select distinct source_name, path, chunk_id from chunk_fts c where not exists (select 1 from file_chunks k where k.source_name = c.source_name and k.path = c.path and k.chunk_id = c.chunk_id)",
    "chunk_ids_by_file": "select source_name, path, string_agg(chunk_id, ',' order by ordinal, chunk_id) as ids from (select distinct source_name, path, chunk_id, ordinal from file_chunks) group by 1, 2",
    "range_merge": f"with {_MERGED} select source_name, path, s::bigint as start, e::bigint as \"end\" from g",
    "range_gaps": f"""with {_MERGED}, t as (select source_name, path, len(string_split(text, e'\\n')) as total from raw_files where lower(path) like '%.php'),
        x as (select source_name, path, s, e from g union all select source_name, path, total + 1, total + 1 from t),
        y as (select source_name, path, coalesce(lag(e) over (partition by source_name, path order by s), 0) + 1 as a, s - 1 as b from x)
        select source_name, path, a::bigint as start, least(b, total)::bigint as "end" from y join t using (source_name, path) where a <= b and a <= total""",
    "asof_nearest": """with p as (select distinct source_name, path, start_line as line from php_doc_info), m as (select distinct source_name, path, start_line, start_byte, name from php_ast_symbol where kind not in ('method', 'function'))
        select p.source_name, p.path, p.line::bigint as line, (select arg_max(name, (start_line, start_byte)) from m where m.source_name = p.source_name and m.path = p.path and m.start_line <= p.line) as name from p""",
    "range_contain": """select distinct d.source_name, d.path, d.start_line::bigint as line, s.name from php_doc_info d join php_ast_symbol s on s.source_name = d.source_name and s.path = d.path
        and d.start_line between s.start_line and s.end_line where s.kind not in ('method', 'function')""",
    "eval_rows": _eval_sql('select case_id, "group", id_prefix, filter_lang, first_rank, path_rank, hit_at_5, hit_at_10, path_hit_at_5, path_hit_at_10 from e'),
    "eval_totals": _eval_sql(f"select {_RATED} from (select {_COUNTS} from e)"),
    "eval_by_group": _eval_sql(
        f"""select dimension, value, {_RATED} from (select 'group' as dimension, "group" as value, {_COUNTS} from e group by 2 union all select 'id_prefix', id_prefix, {_COUNTS} from e group by 2
        union all select 'filter_lang', coalesce(nullif(filter_lang, ''), 'unknown'), {_COUNTS} from e group by 2)"""
    ),
    "eval_failed": _eval_sql("select case_id from e where not hit_at_10"),
    "eval_path_only": _eval_sql("select case_id, path_rank from e where path_rank is not null"),
    "eval_top_paths": _eval_sql("select case_id, paths from e"),
    "index_stats": f"""with {_M}, o as (select f.*, case when size_bytes > {MAX_BYTES} then 'too_large' when exists (select 1 from m where {_NEW} and m.file_hash = sha256(coalesce(f.text, ''))) then 'skipped'
            when trim(coalesce(text, '')) = '' then 'empty' else 'indexed' end as outcome from raw_files f),
        c as (select source_name, path, count(distinct chunk_id) as n from chunk_fts group by 1, 2), x as (select outcome, size_bytes, case when outcome = 'indexed' then n end as n from o left join c using (source_name, path))
        select count(*) as scanned, count_if(outcome = 'indexed')::bigint as indexed, count_if(outcome = 'skipped')::bigint as skipped, count_if(outcome = 'empty')::bigint as empty, count_if(outcome = 'too_large')::bigint as too_large, 0::bigint as failed,
            round(sum(size_bytes) / 1048576.0, 6) as mib, coalesce(sum(n), 0)::bigint as chunks, round(coalesce(avg(n), 0), 6) as average_chunks, coalesce(max(n), 0) as most_chunks from x""",
    "stage_timings": """select bucket, round(sum(coalesce(value, 0)), 4) as seconds, case bucket when 'scan' then 1 when 'hash' then 4 when 'chunk' then 6 when 'embed' then 7 else 13 end::bigint as position
        from (select ['hash', 'embed', 'scan', 'chunk', 'other'][event_id % 5 + 1] as bucket, value from events) group by bucket""",
    "collection_stats": "select source_name, count(distinct chunk_id) as chunks, count(distinct path) as files, count(distinct lower(trim(language))) as languages from chunk_fts group by 1",
    "events_tumbling": "select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2",
    "events_sliding": "select w as window_start, count(*) as events, count(distinct user_id) as users from (select unnest([date_trunc('day', ts)::timestamp, date_trunc('day', ts)::timestamp - interval 1 day]) as w, user_id from events) group by 1",
    "events_session": """with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events),
        s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from o) select user_id, min(ts) as session_start, count(*) as events from s group by user_id, n""",
    "index_source_counts": "select source_name, count(distinct path) as files from raw_files group by 1",
    "stream_index_counts": "select source_name, count(distinct path) as files from raw_files group by 1",
}
