"""Queries of lexical, dense and fused search, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.operators import dense, fusion, lexical, manifest
from loomdex.operators.chunking import ChunkConfig, chunk_windows
from loomdex.operators.filters import Scope
from loomdex.operators.search import Index, respond, search
from loomdex.plans.tables import table
from loomdex.sources.shared import shared_table

QUESTIONS = (("q1", "the strict handler and public_table"), ("q2", "временный пользователь закрывает компонент"), ("q3", "index page catalogue report"))
MODEL, PREFIX = "lumen-code-96", "passage: "


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id string, query string")


def points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def fiftieth(rows: DataFrame) -> DataFrame:
    return rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def documents_index(spark, folder):
    return lexical.build_index(table(spark, folder, "documents"), "doc_id", ["text"])


def token_df(spark, folder):
    index = documents_index(spark, folder)
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def corpus_stats(spark, folder):
    return documents_index(spark, folder).statistics.select("n", F.round("average", 6).alias("average"))


def _ranked(found: DataFrame, key: str = "id") -> DataFrame:
    return found.select("query_id", F.col(key), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_search(spark, folder):
    return _ranked(lexical.bm25(documents_index(spark, folder), questions(spark), 10))


def bm25_filtered_lang(spark, folder):
    """Windows of documents, BM25, a language filter, the ten best: the smallest whole query."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    chunks = chunk_windows(docs, ChunkConfig(1200, 150)).select(F.format_string("%d:%d", "doc_id", F.col("ordinal")).alias("chunk_id"), "lang", "chunk")
    chunks = shared_table(chunks, "windows")  # indexed, and read for the filter
    index = lexical.build_index(chunks, "chunk_id", ["chunk"])
    return _ranked(lexical.bm25(index, questions(spark), 10, chunks.where("lang = 'en'").select(F.col("chunk_id").alias("id"))))


def _chunks(spark, folder):
    """The chunk table with one row for each id; rows of one id are equal."""
    return shared_table(table(spark, folder, "chunk_fts").dropDuplicates(["chunk_id"]), "chunks")


def bm25_path_like(spark, folder):
    chunks = _chunks(spark, folder)
    index = lexical.build_index(chunks, "chunk_id", ["text", "text_for_embedding"])
    kept = Scope(path="LIB/_a%", lang=" PHP ").apply(chunks, "like").select(F.col("chunk_id").alias("id"))
    return _ranked(lexical.bm25(index, _code_questions(spark), 10, kept))


def _code_questions(spark):
    return spark.createDataFrame([("c1", "shared_table order filter"), ("c2", "sprintf count array")], "query_id string, query string")


def bm25_phrase(spark, folder):
    asked = spark.createDataFrame([("p1", "the_strict"), ("p2", "старый_контроллер page")], "query_id string, query string")
    return _ranked(lexical.bm25(documents_index(spark, folder), asked, 20))


def sparse_search(spark, folder):
    chunks = _chunks(spark, folder)
    return _ranked(lexical.bm25(lexical.build_index(chunks, "chunk_id", ["text_for_embedding"]), _code_questions(spark), 10))


def path_words_filter(spark, folder):
    rows = _chunks(spark, folder)
    return Scope(path="lib modules").apply(rows, "words").select("chunk_id", "rel_path")


def _nearest(spark, folder, metric, threshold=None, label=None, limit=10):
    p = points(spark, folder)
    kept = p if label is None else p.where(F.col("label") == label)
    found = dense.nearest(kept, fiftieth(p), limit, metric, threshold)
    return found.select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def knn_cosine(spark, folder):
    return _nearest(spark, folder, "cosine")


def knn_dot(spark, folder):
    return _nearest(spark, folder, "dot")


def knn_l2(spark, folder):
    return _nearest(spark, folder, "l2")


def knn_filtered(spark, folder):
    return _nearest(spark, folder, "cosine", label=3)


def knn_threshold(spark, folder):
    p = points(spark, folder)
    found = dense.nearest(p, fiftieth(p), None, "cosine", 0.3)
    return found.select("query_id", "id", F.round("score", 5).alias("score"))


def _legs(spark, folder):
    p = points(spark, folder)
    q = fiftieth(p)
    return {"cosine": dense.nearest(p, q, 20, "cosine"), "dot": dense.nearest(p, q, 20, "dot"), "l2": dense.nearest(p, q, 20, "l2")}


def _fused(found):
    return found.select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def rrf_two_way(spark, folder):
    legs = _legs(spark, folder)
    return _fused(fusion.fuse({k: legs[k] for k in ("cosine", "dot")}, ["query_id"], limit=10))


def rrf_three_way(spark, folder):
    return _fused(fusion.fuse(_legs(spark, folder), ["query_id"], limit=10))


def rrf_tie_order(spark, folder):
    p = points(spark, folder)
    first = lambda order: p.orderBy(order).limit(30).select("id", F.lit(0.0).alias("score"), F.row_number().over(Window.orderBy(order)).alias("rank"))
    a, b = first(F.asc("id")), first(F.desc("id"))
    found = fusion.fuse({"a": a, "b": b})
    return found.select("id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"), F.col("a_rank").cast("long").alias("a_rank"), F.col("b_rank").cast("long").alias("b_rank"))


def retrieve_ordered(spark, folder):
    asked = table(spark, folder, "embeddings").where("vec_id % 50 = 0").select((F.lit(1_000_000) - F.col("vec_id")).alias("pos"), F.when(F.col("vec_id") % 100 == 0, F.col("vec_id")).otherwise(-F.col("vec_id")).alias("id"))
    return manifest.retrieve(points(spark, folder).select("id", "label"), asked).select("pos", "id", "label")


def embed_cache_misses(spark, folder):
    texts = table(spark, folder, "chunk_fts").select(F.col("text_for_embedding").alias("text"))
    return dense.cache_misses(texts, table(spark, folder, "dense_embedding_cache"), MODEL, PREFIX).select("text_hash")


def embed_cache_hit_stats(spark, folder):
    texts = table(spark, folder, "chunk_fts").select(F.col("text_for_embedding").alias("text"))
    return dense.cache_statistics(texts, table(spark, folder, "dense_embedding_cache"), MODEL, PREFIX)


def _waves(texts):
    """An embedder that SQL can follow: the i-th of 96 numbers is sin(i * characters)."""
    return np.array([[math.sin((i + 1) * len(t)) for i in range(96)] for t in texts], dtype=np.float32)


def _index(spark, folder):
    """The chunks with the given vectors of MODEL, the newest usable one of each text; questions get the vectors of `_waves`."""
    chunks = _chunks(spark, folder)
    cache = table(spark, folder, "dense_embedding_cache").where((F.col("model_name") == MODEL) & F.col("text_hash").isNotNull() & F.col("created_at").isNotNull())
    newest = cache.groupBy("text_hash").agg(F.max_by(F.struct("dim", "vector"), "created_at").alias("v")).select("text_hash", "v.*")
    whole = newest.where("size(vector) = 96 and dim = 96 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    hashed = chunks.select(F.col("chunk_id").alias("id"), dense.text_hash(PREFIX, "text_for_embedding").alias("text_hash"))
    return Index(chunks, hashed.join(whole, "text_hash").select("id", "vector"), _waves)


def hybrid_search(spark, folder):
    found = search(_index(spark, folder), _code_questions(spark), "hybrid", 10, Scope(lang="php"))
    ranks = [F.col(c).cast("long").alias(c) for c in ("rank", "dense_rank", "lexical_rank")]
    return found.select("query_id", "id", *ranks, F.round("score", 9).alias("score"), "rel_path")


def hybrid_fused_search(spark, folder):
    found = search(_index(spark, folder), _code_questions(spark), "hybrid-fused", 10)
    told = respond(found, max_text_chars=400).select("query_id", "count", F.inline("results"))
    return told.select("query_id", F.col("count").cast("long").alias("count"), F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), "id", "path", "language", "text")


QUERIES = {f.__name__: f for f in (
    token_df, corpus_stats, bm25_search, bm25_filtered_lang, bm25_path_like, bm25_phrase, sparse_search, path_words_filter, knn_cosine, knn_dot, knn_l2, knn_filtered, knn_threshold,
    rrf_two_way, rrf_three_way, rrf_tie_order, retrieve_ordered, embed_cache_misses, embed_cache_hit_stats, hybrid_search, hybrid_fused_search,
)}

_TERMS = "regexp_extract_all(translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(texts: str, fields: list[str], phrases: list[tuple[str, int, list[str]]], limit: int, allowed: str = "true") -> str:
    """texts: a select with id and the fields; phrases: (query, number, terms)."""
    asked = ", ".join(f"('{q}', {n}, {list(t)!r})" for q, n, t in phrases)
    lists = [_TERMS.format(f"coalesce({f}, '')") for f in fields]
    words = " union all ".join(f"select id, {n} as field, unnest(range(len(a))) as pos, unnest(a) as term from (select id, {x} as a from t)" for n, x in enumerate(lists))
    return f"""
        with t as ({texts}), w as materialized ({words}), p(query_id, phrase_id, terms) as (values {asked}),
        lengths as (select id, {' + '.join(f'len({x})' for x in lists)} as length from t), s as (select count(*) as n, avg(length) as average from lengths),
        one as (select query_id, phrase_id, id, count(*) as tf from p join w on w.term = terms[1] where len(terms) = 1 group by all),
        two as (select query_id, phrase_id, a.id, count(*) as tf from p join w a on a.term = terms[1] join w b on b.id = a.id and b.field = a.field and b.pos = a.pos + 1 and b.term = terms[2] where len(terms) = 2 group by all),
        hits as (select * from one union all select * from two),
        df as (select query_id, phrase_id, count(distinct id) as df from hits group by all),
        scored as (select query_id, id, sum((case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) as score
            from hits join df using (query_id, phrase_id) join lengths using (id), s where {allowed} group by all),
        r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from scored)
        select query_id, id, round(score, 6) as score, rank from r where rank <= {limit}"""


def _asked(queries) -> list[tuple[str, int, list[str]]]:
    import re

    out = []
    for q, text in queries:
        seen = []
        for w in re.findall(r"\w+", text.lower()):
            if len(w) >= 2 and w not in seen:
                seen.append(w)
        out += [(q, n, w.replace("_", " ").split()) for n, w in enumerate(seen[:16])]
    return out


_ONCE = "select chunk_id as id, any_value(text) as text, any_value(text_for_embedding) as text_for_embedding, any_value(rel_path) as rel_path, any_value(language) as language from chunk_fts group by chunk_id"
_CODE = [("c1", "shared_table order filter"), ("c2", "sprintf count array")]
_WIN = """select doc_id || ':' || ordinal as id, lang, chunk from (select doc_id, lang, row_number() over (partition by doc_id order by i) as ordinal, chunk from (
    select doc_id, lang, i, trim(substr(text, i * 1050 + 1, 1200), e' \\t\\r\\n') as chunk from (select doc_id, lang, text, unnest(range(case when length(text) <= 1200 then 1 else cast(ceil((length(text) - 1200) / 1050.0) as bigint) + 1 end)) as i from documents where text is not null)) where chunk != '')"""


def _knn_sql(score: str, limit: int, order: str = "desc", where: str = "true") -> str:
    return f"""with s as (select q.vec_id as query_id, p.vec_id as id, {score} as score from embeddings q, embeddings p where q.vec_id % 50 = 0 and {where}),
        r as (select *, row_number() over (partition by query_id order by round(score, 9) {order}, id) as rank from s)
        select query_id, id, round(score, 5) as score, rank from r where rank <= {limit}"""


_COS = "list_cosine_similarity(q.embedding::double[], p.embedding::double[])"
_DOT = "list_inner_product(q.embedding::double[], p.embedding::double[])"
_L2 = "list_distance(q.embedding::double[], p.embedding::double[])"


def _rrf_sql(legs: list[tuple[str, str]]) -> str:
    parts = [f"select query_id, id, rank, {n} as leg from ({_knn_sql(score, 20, order)})" for n, (score, order) in enumerate(legs)]
    ranks = ", ".join(f"min(case when leg = {n} then rank end) as r{n}" for n in range(len(legs)))
    order = ", ".join(f"r{n} asc nulls last" for n in range(len(legs)))
    return f"""with a as ({' union all '.join(parts)}), f as (select query_id, id, sum(1.0 / (60 + rank)) as score, {ranks} from a group by all),
        r as (select *, row_number() over (partition by query_id order by round(score, 12) desc, {order}, id) as rank from f)
        select query_id, id, round(score, 9) as score, rank from r where rank <= 10"""


def _hybrid_sql(fields: list[str], second: str, allowed: str, tail: str) -> str:
    """Cosines with the given vectors and BM25, 50 of each, fused."""
    asked = ", ".join(f"('{q}', 'query: {text}')" for q, text in _CODE)
    lexical_leg = _bm25_sql(_ONCE, fields, _asked(_CODE), 50, f"id in (select id from t where {allowed})")
    return f"""
        with c as (select chunk_id as id, any_value(text) as text, any_value(text_for_embedding) as body, any_value(rel_path) as rel_path, any_value(path) as path, any_value(language) as language from chunk_fts group by chunk_id),
        n as (select text_hash, arg_max(dim, created_at) as dim, arg_max(vector, created_at) as v from dense_embedding_cache where model_name = '{MODEL}' and text_hash is not null and created_at is not null group by 1),
        u as (select text_hash, v::double[] as v from n where dim = 96 and len(v) = 96 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x != 0)) > 0),
        p as (select c.*, v from c join u on text_hash = sha256('{PREFIX}' || coalesce(body, '')) where {allowed}),
        a(query_id, asked) as (values {asked}), q as (select query_id, list_transform(range(96), lambda i: sin((i + 1) * length(asked))::float::double) as w from a),
        s as (select query_id, id, list_cosine_similarity(w, v) as score from q, p),
        d as (select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s qualify rank <= 50),
        x as (select query_id, id, rank, 0 as leg from d union all select query_id, id, rank, 1 from ({lexical_leg})),
        f as (select query_id, id, sum(1.0 / (60 + rank)) as score, min(case when leg = 0 then rank end) as dense_rank, min(case when leg = 1 then rank end) as {second}_rank from x group by all),
        r as (select *, row_number() over (partition by query_id order by round(score, 12) desc, dense_rank nulls last, {second}_rank nulls last, id) as rank from f qualify rank <= 10)
        {tail}"""


_HASHED = "select sha256('passage: ' || coalesce(text_for_embedding, '')) as text_hash from chunk_fts"

SQL = {
    "token_df": f"""with w as (select doc_id, unnest({_TERMS.format("coalesce(text, '')")}) as term from documents)
        select term, count(distinct doc_id) as df, count(*)::bigint as occurrences from w group by term""",
    "corpus_stats": f"select count(*) as n, round(avg(len({_TERMS.format("coalesce(text, '')")})), 6) as average from documents",
    "bm25_search": _bm25_sql("select doc_id as id, text from documents", ["text"], _asked(QUESTIONS), 10),
    "bm25_filtered_lang": _bm25_sql(_WIN, ["chunk"], _asked(QUESTIONS), 10, "id in (select id from t where lang = 'en')"),
    "bm25_path_like": _bm25_sql(_ONCE, ["text", "text_for_embedding"], _asked(_CODE), 10, "id in (select id from t where lower(rel_path) like '%lib/_a%%' and language = 'php')"),
    "bm25_phrase": _bm25_sql("select doc_id as id, text from documents", ["text"], [("p1", 0, ["the", "strict"]), ("p2", 0, ["старый", "контроллер"]), ("p2", 1, ["page"])], 20),
    "sparse_search": _bm25_sql(_ONCE, ["text_for_embedding"], _asked(_CODE), 10),
    "hybrid_search": _hybrid_sql(["text", "text_for_embedding"], "lexical", "language = 'php'", "select query_id, id, rank, dense_rank, lexical_rank, round(score, 9) as score, rel_path from r join c using (id)"),
    "hybrid_fused_search": _hybrid_sql(
        ["text_for_embedding"], "sparse", "true",
        r"""select query_id, count(*) over (partition by query_id) as count, rank, round(score, 9) as score, id, coalesce(nullif(rel_path, ''), path) as path, language,
            case when length(coalesce(text, '')) > 400 then regexp_replace(substr(text, 1, 400), '\s+$', '') || e'\n...<truncated>' else coalesce(text, '') end as text from r join c using (id)""",
    ),
    "path_words_filter": r"select distinct chunk_id, rel_path from chunk_fts where list_has_all(regexp_extract_all(lower(rel_path), '[\p{L}\p{N}_]+'), ['lib', 'modules'])",
    "knn_cosine": _knn_sql(_COS, 10),
    "knn_dot": _knn_sql(_DOT, 10),
    "knn_l2": _knn_sql(_L2, 10, "asc"),
    "knn_filtered": _knn_sql(_COS, 10, where="p.label = 3"),
    "knn_threshold": f"select q.vec_id as query_id, p.vec_id as id, round({_COS}, 5) as score from embeddings q, embeddings p where q.vec_id % 50 = 0 and {_COS} >= 0.3",
    "rrf_two_way": _rrf_sql([(_COS, "desc"), (_DOT, "desc")]),
    "rrf_three_way": _rrf_sql([(_COS, "desc"), (_DOT, "desc"), (_L2, "asc")]),
    "rrf_tie_order": """with a as (select vec_id as id, row_number() over (order by vec_id) as a_rank from embeddings qualify a_rank <= 30),
        b as (select vec_id as id, row_number() over (order by vec_id desc) as b_rank from embeddings qualify b_rank <= 30),
        f as (select id, coalesce(1.0 / (60 + a_rank), 0) + coalesce(1.0 / (60 + b_rank), 0) as score, a_rank, b_rank from a full join b using (id))
        select id, round(score, 9) as score, row_number() over (order by round(score, 12) desc, a_rank nulls last, b_rank nulls last, id) as rank, a_rank, b_rank from f""",
    "retrieve_ordered": "select 1000000 - q.vec_id as pos, p.vec_id as id, p.label from embeddings q join embeddings p on p.vec_id = case when q.vec_id % 100 = 0 then q.vec_id else -q.vec_id end where q.vec_id % 50 = 0",
    "embed_cache_misses": f"select distinct text_hash from ({_HASHED}) where text_hash not in (select text_hash from dense_embedding_cache where model_name = '{MODEL}' and text_hash is not null)",
    "embed_cache_hit_stats": f"""with h as ({_HASHED}), m as (select count(distinct text_hash) as misses from h where text_hash not in (select text_hash from dense_embedding_cache where model_name = '{MODEL}' and text_hash is not null))
        select (select count(*) from h) - misses as hits, misses from m""",
}
