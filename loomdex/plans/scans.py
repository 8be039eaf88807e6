"""Queries of scans, projections and chunk generators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.operators import chunking, code, manifest
from loomdex.plans.tables import table
from loomdex.sources.files import first_files, from_table, included, within_size

CONFIG = chunking.ChunkConfig(1200, 150)
EXCLUDE = ["vendor/", "node_modules/", "*.min.js", "/templates/*/components/**", "!/templates/*/components/**/*.php", "package-lock.json"]
INCLUDE = ["**/*.php", "js/**/*.js"]


def files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_files")


def scan_filter_size(spark, folder):
    rows = from_table(files(spark, folder), "source_name", "path", "text")
    return within_size(rows, 4000).select("source_name", "path", "size_bytes")


def scan_exclude(spark, folder):
    return files(spark, folder).where(~T.ignored(F.col("rel_path"), EXCLUDE)).select("source_name", "rel_path")


def scan_include(spark, folder):
    return files(spark, folder).where(included(F.col("rel_path"), INCLUDE)).select("source_name", "rel_path")


def scan_top_files(spark, folder):
    return first_files(files(spark, folder), 20).select("source_name", "path", "size_bytes")


def file_hash_sha256(spark, folder):
    return files(spark, folder).select("source_name", "path", manifest.file_hash().alias("file_hash"))


def chunk_id_uuid5(spark, folder):
    links = table(spark, folder, "file_chunks")
    return links.select("source_name", "path", F.col("ordinal").cast("long").alias("ordinal"), T.chunk_id(F.col("source_name"), F.col("path"), F.col("ordinal")).alias("id"))


def detect_language(spark, folder):
    return files(spark, folder).select("source_name", "path", T.language_of(F.col("path")).alias("detected"))


def search_language(spark, folder):
    return table(spark, folder, "chunk_fts").select("language").distinct().select("language", T.search_language(F.col("language")).alias("normalised"))


def truncate_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.truncated(F.col("text"), 300).alias("short"))


def rel_path(spark, folder):
    rows = files(spark, folder)
    return rows.select("source_name", T.relative_path(F.col("path"), "/srv/portals").alias("below"))


def chunk_windows(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return chunking.chunk_windows(docs, CONFIG).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "chunk")


def chunk_windows_stats(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    out = chunking.chunk_windows(docs, CONFIG)
    return out.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.max(F.length("chunk")).cast("long").alias("longest"))


def chunk_huge_line(spark, folder):
    rows = files(spark, folder).select("source_name", "path", F.posexplode(T.lines_with_ends(F.col("text"))).alias("line", "t"))
    long = rows.where(F.length("t") > 600).select("source_name", "path", "line", F.posexplode(chunking.huge_line_slices(F.col("t"), 600)).alias("part", "piece"))
    return long.select("source_name", "path", F.col("line").cast("long").alias("line"), F.col("part").cast("long").alias("part"), "piece")


def chunk_lines(spark, folder):
    return chunking.pack_lines(table(spark, folder, "documents"), "doc_id", CONFIG)


def chunk_lines_sql(spark, folder):
    return chunking.pack_lines_sql(table(spark, folder, "documents"), "doc_id", CONFIG)


def chunk_headings(spark, folder):
    return chunking.chunk_headings(table(spark, folder, "documents"), "doc_id", chunking.CONFIGS["markdown"])


def chunk_router(spark, folder):
    rows = files(spark, folder).withColumn("language", T.language_of(F.col("path")))
    return chunking.chunk_files(rows)


def chunk_router_plain(spark, folder):
    """All files but PHP, with every column; PHP is cut by a parser, which SQL has none of (see `code_chunk_spans`)."""
    rows = files(spark, folder).withColumn("language", T.language_of(F.col("path"))).where("language != 'php'")
    return chunking.chunk_files(rows).drop(*code.names_of(code.PAYLOAD))


def word_tokens(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("words"))


def query_tokens_dedupe16(spark, folder):
    return table(spark, folder, "eval_cases").select("case_id", F.array_join(T.query_terms(F.col("query")), " ").alias("terms"))


def code_symbols(spark, folder):
    """Of the files that the given table holds, as its SQL can tell of no others; `code_symbols_whole` has all."""
    known = table(spark, folder, "php_ast_symbol").select("source_name", "path").distinct()
    return _symbols(files(spark, folder).join(known, ["source_name", "path"], "left_semi"))


def code_symbol_ends(spark, folder):
    """Where symbols end, but in files with `\\r`, which the given table counts otherwise, and in files that end with a comment, which it counts to the symbol before."""
    rows = _known(spark, folder).where(~F.contains("text", F.lit("\r")) & ~F.col("text").rlike(_LAST_COMMENT))
    ends = [F.col(c).cast("long").alias(c) for c in ("start_byte", "end_line", "end_byte")]
    return code.php_symbols(rows).select("source_name", "path", "kind", "name", *ends)


def code_symbols_whole(spark, folder):
    return _symbols(files(spark, folder))


def _symbols(rows):
    found = code.php_symbols(rows.where(F.lower("path").endswith(".php")))
    # the given table ends symbols of CRLF files behind the "\\r", so ends are left to the unit tests
    ints = ("start_line", "start_byte")
    return found.select("source_name", "path", "kind", "name", *[F.col(c).cast("long").alias(c) for c in ints], "parent_kind", "parent_name", "visibility", "is_static", "is_abstract", "is_final", "has_body")


def code_chunks(spark, folder):
    rows = files(spark, folder).where(F.lower("path").endswith(".php")).withColumn("file", F.concat_ws("|", "source_name", "path"))
    return code.chunk_php_files(rows, "file")


def _known(spark, folder):
    """The PHP files that the given table of symbols tells of."""
    known = table(spark, folder, "php_ast_symbol").select("source_name", "path").distinct()
    return files(spark, folder).join(known, ["source_name", "path"], "left_semi").where(F.lower("path").endswith(".php"))


def code_fqn(spark, folder):
    """Names of the callables by which files are cut; as `code_symbols`, of the files that the given table holds."""
    rows = _known(spark, folder).withColumn("file", F.concat_ws("|", "source_name", "path"))
    cut = code.chunk_php_files(rows, "file").where("symbol_kind is not null")
    return cut.select(F.split_part("file", F.lit("|"), F.lit(1)).alias("source_name"), F.split_part("file", F.lit("|"), F.lit(2)).alias("path"), F.col("symbol_fqn").alias("fqn")).distinct()


def code_chunk_spans(spark, folder):
    """The lines and the code of every callable that is one chunk, of the files that the given tables hold."""
    rows = _known(spark, folder).withColumn("file", F.concat_ws("|", "source_name", "path"))
    cut = code.chunk_php_files(rows, "file", code.ChunkConfig(1_000_000, 300)).where("symbol_kind is not null")
    ends = [F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")]
    return cut.select("file", F.col("symbol_name").alias("name"), *ends, F.md5(F.regexp_replace("chunk", r"[ \t\r]+(?=\n|$)", "")).alias("code")).distinct()


def doc_tags(spark, folder):
    rows = files(spark, folder).where(F.lower("path").endswith(".php"))
    return rows.select("source_name", "path", F.array_join(code.doc_tags(F.col("text")), ",").alias("tags"))


def component_context(spark, folder):
    rows = files(spark, folder).select("source_name", "rel_path", code.component(F.col("rel_path")).alias("c"))
    return rows.where("c.name is not null").select("source_name", "rel_path", F.col("c.name").alias("component"), "c.site_template")


_LAST_COMMENT = r"\}\s*(//[^\n]*|/\*([^*]|\*+[^*/])*\*+/)\s*$"
_UUID_NS = T.NAMESPACE.hex
_C, _O = CONFIG.max_chars, CONFIG.overlap_chars
_WINDOWS = f"""
    select doc_id, source, i + 1 as ordinal, trim(substr(text, i * {_C - _O} + 1, {_C}), e' \\t\\r\\n') as chunk
    from (select doc_id, source, text, unnest(range(case when length(text) <= {_C} then 1 else cast(ceil((length(text) - {_C}) / {_C - _O}.0) as bigint) + 1 end)) as i
          from documents where text is not null)"""

QUERIES = {f.__name__: f for f in (
    scan_filter_size, scan_exclude, scan_include, scan_top_files, file_hash_sha256, chunk_id_uuid5, detect_language, search_language, truncate_text, rel_path, chunk_windows, chunk_windows_stats,
    chunk_huge_line, chunk_lines, chunk_lines_sql, chunk_headings, chunk_router, chunk_router_plain, word_tokens, query_tokens_dedupe16, code_symbols, code_symbol_ends, code_symbols_whole, code_chunks, code_chunk_spans, code_fqn, doc_tags, component_context,
)}

# line packing as a recursion over lines: b is the first line held, c the characters held, o the pieces so far, out what a line's arrival closes
def _packed(texts: str, most: int = _C, overlap: int = _O) -> str:
    """texts: a select with doc_id and text."""
    return rf"""with recursive l as (select doc_id, a, list_transform(a, lambda x: length(x)) as z from (select doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as a from ({texts}) where text is not null)),
    d as (select *, list_transform(range(len(z) + 1), lambda i: coalesce(list_sum(z[1:i]), 0)) as ends from l where len(a) > 0),
    r as (select doc_id, 0 as i, 0 as b, 0::bigint as c, 0::bigint as o, []::struct(s bigint, e bigint, n bigint)[] as shut from d
        union all
        select r.doc_id, r.i + 1, case when i + 1 > len(z) or huge then 0 when over then kept + 1 when b = 0 then i + 1 else b end,
            case when i + 1 > len(z) or huge then 0 when over then ends[i + 1] - ends[kept + 1] + z[i + 1] else c + z[i + 1] end,
            o + (case when flushed then 1 else 0 end) + (case when huge then cast(ceil(z[i + 1] / {most}.0) as bigint) else 0 end),
            case when flushed then [{{'s': b, 'e': i, 'n': o + 1}}] else [] end
        from (select *, coalesce(z[i + 1] > {most}, false) as huge, b > 0 and (i + 1 > len(z) or z[i + 1] > {most} or c + z[i + 1] > {most}) as flushed, b > 0 and c + z[i + 1] > {most} as over,
                greatest(b - 1, least(i - 1, len(list_filter(ends, lambda x: x < ends[i + 1] - {overlap})))) as kept
            from r join d using (doc_id) where i <= len(z)) r),
    p as (select doc_id, u.n, u.s, u.e, array_to_string(a[u.s:u.e], '') as t from (select doc_id, unnest(shut) as u from r) join d using (doc_id)
        union all
        select doc_id, before + flush + k + 1, line, line, substr(a[line], k * {most} + 1, {most}) from (select doc_id, a, line, before, flush, unnest(range(cast(ceil(z[line] / {most}.0) as bigint))) as k
            from (select r.doc_id, r.i + 1 as line, r.o as before, case when r.b > 0 then 1 else 0 end as flush, a, z from r join d using (doc_id) where coalesce(z[r.i + 1], 0) > {most})))
    select doc_id, n::int as ordinal, s::int as start_line, e::int as end_line, trim(t, e' \t\r\n') as chunk from p where trim(t, e' \t\r\n') != ''"""


def _headed(texts: str) -> str:
    """As `_packed`, by headings, in windows of 1800 that overlap by 200."""
    return rf"""with l as (select doc_id, unnest(range(len(a))) as n, unnest(a) as t from (select doc_id, case when a[-1] = '' then a[:-2] else a end as a from
                (select doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') as a from ({texts}) where text is not null))),
        b as (select *, sum(case when regexp_matches(t, '^##? ') then 1 else 0 end) over (partition by doc_id order by n) as block from l),
        w as (select doc_id, min(n) + 1 as s, max(n) + 1 as e, trim(string_agg(t, e'\n' order by n), e' \t\r\n') as body from b group by doc_id, block),
        p as (select doc_id, s, e, i, trim(substr(body, i * 1600 + 1, 1800), e' \t\r\n') as chunk
            from (select *, unnest(range(case when length(body) <= 1800 then 1 else cast(ceil((length(body) - 1800) / 1600.0) as bigint) + 1 end)) as i from w where body != ''))
        select doc_id, row_number() over (partition by doc_id order by s, i)::int as ordinal, s::int as start_line, e::int as end_line, chunk from p where chunk != ''"""


def _router_sql() -> str:
    """Files but PHP: those three ways, with their headers, ids and hashes."""
    language = r"case lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) when '.php' then 'php' when '.js' then 'javascript' when '.ts' then 'typescript' when '.vue' then 'vue' when '.html' then 'html' when '.md' then 'markdown' else 'text' end"
    of = lambda which: f"select source_name || '|' || path as doc_id, text from (select *, {language} as l from raw_files) where l {which}"
    code_, text_ = "in ('javascript', 'typescript', 'vue')", "not in ('php', 'markdown', 'javascript', 'typescript', 'vue')"
    return f"""
        with f as (select *, source_name || '|' || path as doc_id, {language} as l from raw_files),
        p as (select *, false as lines from ({_headed(of("= 'markdown'"))}) union all select *, true from ({_packed(of(code_), 2600, 300)}) union all select *, true from ({_packed(of(text_), 2200, 250)})),
        t as (select source_name, f.path, rel_path, l as language, ordinal, start_line, end_line, chunk,
            'Path: ' || f.path || e'\\nLanguage: ' || l || case when lines then e'\\nLines: ' || start_line || '-' || end_line else '' end || e'\\n\\n' || chunk as text_for_embedding,
            sha1(unhex('{_UUID_NS}') || encode(source_name || ':' || f.path || ':' || ordinal)) as h from p join f using (doc_id))
        select * exclude (h), sha256(text_for_embedding) as content_hash, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
            substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as chunk_id from t"""


SQL = {
    "scan_filter_size": "select source_name, path, strlen(text)::bigint as size_bytes from raw_files where strlen(text) <= 4000",
    "scan_exclude": r"""select source_name, rel_path from raw_files where not (
        case when regexp_matches(rel_path, '(^|/)package-lock\.json(/|$)') then true
             when regexp_matches(rel_path, '^templates/[^/]*/components/.*\.php$') then false
             when regexp_matches(rel_path, '^templates/[^/]*/components/') then true
             else regexp_matches(rel_path, '(^|/)(vendor|node_modules)/') or regexp_matches(rel_path, '(^|/)[^/]*\.min\.js(/|$)') end)""",
    "scan_include": r"select source_name, rel_path from raw_files where regexp_matches(rel_path, '^(.*/)?[^/]*\.php$') or regexp_matches(rel_path, '^js/(.*/)?[^/]*\.js$')",
    "scan_top_files": "select source_name, path, size_bytes from raw_files order by path, source_name limit 20",
    "file_hash_sha256": "select source_name, path, sha256(text) as file_hash from raw_files",
    "chunk_id_uuid5": f"""select source_name, path, ordinal::bigint as ordinal, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
            substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id
        from (select *, sha1(unhex('{_UUID_NS}') || encode(source_name || ':' || path || ':' || ordinal)) as h from file_chunks)""",
    "detect_language": r"""select source_name, path, case lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) when '.php' then 'php' when '.js' then 'javascript' when '.ts' then 'typescript'
        when '.vue' then 'vue' when '.html' then 'html' when '.md' then 'markdown' else 'text' end as detected from raw_files""",
    "search_language": """select distinct language, case lower(trim(language)) when 'js' then 'javascript' when 'jsx' then 'javascript' when 'ts' then 'typescript' when 'tsx' then 'typescript'
        when 'md' then 'markdown' when 'yml' then 'yaml' when '' then null else lower(trim(language)) end as normalised from chunk_fts""",
    "truncate_text": r"""select doc_id, case when length(text) > 300 then regexp_replace(substr(text, 1, 300), '\s+$', '') || e'\n...<truncated>' else text end as short from documents""",
    "rel_path": "select source_name, substr(path, length('/srv/portals/') + 1) as below from raw_files",
    "chunk_windows": f"select doc_id, ordinal, chunk from (select doc_id, row_number() over (partition by doc_id order by ordinal) as ordinal, chunk from ({_WINDOWS}) where chunk != '')",
    "chunk_windows_stats": f"select source, count(*) as chunks, sum(length(chunk))::bigint as chars, max(length(chunk))::bigint as longest from ({_WINDOWS}) where chunk != '' group by source",
    "chunk_huge_line": r"""with l as (select source_name, path, unnest(range(len(a))) as line, unnest(a) as t from (select source_name, path, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as a from raw_files))
        select source_name, path, line, part, substr(t, part * 600 + 1, 600) as piece from (select *, unnest(range(cast(ceil(length(t) / 600.0) as bigint))) as part from l where length(t) > 600)""",
    "chunk_headings": _headed("select doc_id, text from documents"),
    "chunk_lines": _packed("select doc_id, text from documents"),
    "chunk_lines_sql": _packed("select doc_id, text from documents"),
    "chunk_router_plain": _router_sql(),
    "code_chunk_spans": r"""with f as (select source_name, path, string_split(text, e'\n') as a from raw_files where lower(path) like '%.php'),
        s as (select distinct source_name, path, name, start_line as s, end_line as e from php_ast_symbol where kind in ('method', 'function')),
        d as (select distinct source_name, path, start_line as ds, end_line as de from php_doc_info),
        n as (select s.*, a, list_max(list_filter(range(1, s.s), lambda i: trim(a[i], e' \t\r') != '')) as above from s join f using (source_name, path)),
        k as (select n.source_name, n.path, n.name, n.s, n.e, n.a, max(d.ds) as ds from n left join d on d.source_name = n.source_name and d.path = n.path and d.de = n.above
            and regexp_matches(n.a[n.above], '\*/\s*$') group by all),
        j as (select *, coalesce(ds, s) as first from k)
        select distinct source_name || '|' || path as file, name, first::bigint as start_line, e::bigint as end_line,
            md5(regexp_replace(trim(array_to_string(a[first:e], e'\n'), e' \t\r\n'), '[ \t\r]+(\n|$)', '\1', 'g')) as code from j""",
    "word_tokens": r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) as words from documents",
    "query_tokens_dedupe16": r"""with w as (select case_id, unnest(range(len(a))) as i, unnest(a) as w from (select case_id, regexp_extract_all(lower(query), '[\p{L}\p{N}_]+') as a from eval_cases)),
        f as (select case_id, w, min(i) as i from w where length(w) >= 2 group by case_id, w), r as (select *, row_number() over (partition by case_id order by i) as n from f)
        select case_id, string_agg(w, ' ' order by i) as terms from r where n <= 16 group by case_id""",
    "code_symbols": """select distinct source_name, path, kind, name, start_line::bigint as start_line, start_byte::bigint as start_byte,
        parent_kind, parent_name, visibility, is_static, is_abstract, is_final, has_body from php_ast_symbol""",
    "code_symbol_ends": f"""select distinct source_name, path, kind, name, start_byte::bigint as start_byte, end_line::bigint as end_line, end_byte::bigint as end_byte from php_ast_symbol
        where (source_name, path) in (select (source_name, path) from raw_files where not contains(text, chr(13)) and not regexp_matches(text, '{_LAST_COMMENT}'))""",
    "code_fqn": r"""with f as (select source_name, path, nullif(regexp_extract(text, '(?m)^\s*namespace\s+([\w\\]+)\s*[;{]', 1), '') as ns from raw_files where lower(path) like '%.php'),
        s as (select distinct source_name, path, kind, case when kind = 'method' and parent_name is not null then parent_name || '::' || name when kind = 'function' then name end as local from php_ast_symbol where kind in ('method', 'function'))
        select distinct source_name, path, case when ns is not null then ns || '\' || local else local end as fqn from s join f using (source_name, path)""",
    "doc_tags": r"""with b as (select source_name, path, regexp_extract_all(text, '(?s)/\*\*.*?\*/') as a from raw_files where lower(path) like '%.php')
        select source_name, path, coalesce(array_to_string(list_sort(list_distinct(list_transform(flatten(list_transform(a, lambda x: regexp_extract_all(x, '(?m)^\s*(?:/\*\*|\*)?\s*@([\w-]+)', 1))), lambda y: lower(y)))), ','), '') as tags from b""",
    "component_context": r"""with p as (select source_name, rel_path, string_split(rel_path, '/') as a from raw_files)
        select source_name, rel_path, case when a[1] = 'components' then a[2] || ':' || a[3] else a[4] || ':' || a[5] end as component, case when a[1] = 'templates' then a[2] end as site_template
        from p where (a[1] = 'components' and len(a) >= 3) or (a[1] = 'templates' and a[3] = 'components' and len(a) >= 6)""",
}
