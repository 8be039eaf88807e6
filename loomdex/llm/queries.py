"""Queries of the subpackage's operators, with SQL where SQL can say the same on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.docpairs import documented_functions
from loomdex.llm.handwritten import classify_files
from loomdex.llm.language import label_documents, label_segments
from loomdex.llm.leaks import leaks
from loomdex.llm.neardup import groups, near_duplicates, pairs_of_ids
from loomdex.llm.packing import pack, report
from loomdex.llm.parsing import check_files, rates
from loomdex.llm.secrets import find_secrets, redact
from loomdex.llm.vectors import similar_vectors
from loomdex.plans.tables import table as read


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = similar_vectors(read(spark, folder, "dense_embedding_cache"))
    return found.where(F.col("cosine") >= 0.8).select("model_name", "text_hash", "neighbour_hash")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(read(spark, folder, "chunk_fts"), "chunk_id", "text", run=3, threshold=0.7, counted=False)
    return pairs_of_ids(found).toDF("chunk_id_a", "chunk_id_b")


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups(near_duplicates(read(spark, folder, "chunk_fts"), "chunk_id", "text_for_embedding"))


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(read(spark, folder, "documents"), read(spark, folder, "eval_cases"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).where("kind = 'verbatim'").select("doc_id", "case_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    found = label_segments(read(spark, folder, "documents"))
    return found.where("language is not null and (named is null or language != named)").select("doc_id", "segment_no", F.col("language").alias("true_lang"))


def p10_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    return label_documents(label_segments(documents), documents=documents)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(read(spark, folder, "chunk_fts"), "chunk_id", "text").select("chunk_id", "start_char")


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redact(read(spark, folder, "chunk_fts").select("chunk_id", "text"), "text")


def p4_files(spark: SparkSession, folder: str) -> DataFrame:
    return classify_files(read(spark, folder, "chunk_fts"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_files(spark, folder).where("kind != 'handwritten'").select("source_name", "path")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return documented_functions(*(read(spark, folder, t) for t in ("php_ast_symbol", "php_doc_info", "raw_files")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pairs(spark, folder).select("source_name", "path", "name", "start_line")


def p7_files(spark: SparkSession, folder: str) -> DataFrame:
    return check_files(read(spark, folder, "chunk_fts"), read(spark, folder, "raw_files"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_files(spark, folder).where("not valid").select("source_name", "path")


def p7_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rates(p7_files(spark, folder))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"), read(spark, folder, "pack_capacity"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return report(p8_pack(spark, folder), read(spark, folder, "pack_capacity"))


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """Of the packing: documents, pieces and tokens of each kind, and containers above the capacity."""
    packed, kinds = p8_pack(spark, folder), read(spark, folder, "pack_capacity")
    filled = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("filled"), F.count("*").alias("pieces"))
    capacity = kinds.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    whole = filled.join(capacity, "container_kind").groupBy("container_kind").agg(F.sum("pieces").alias("pieces"), F.sum("filled").alias("tokens"), F.count_if(F.col("filled") > F.col("capacity")).alias("overfull"))
    documents = packed.groupBy("container_kind").agg(F.countDistinct("doc_id").alias("documents"))
    return whole.join(documents, "container_kind").select("container_kind", "documents", "pieces", "tokens", "overfull")


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_redacted, p4_found, p4_files, p5_found, p5_pairs, p6_found, p6_groups, p7_found, p7_rates, p8_pack, p8_report, p8_check, p9_found, p9_leaks, p10_found, p10_documents)}
# Where an answer is exact and SQL can give it over whole tables in reasonable time. p1's operator is an index: on the small
# tables it finds all of these; on larger ones tests measure its recall.
SQL: dict[str, str] = {
    "p1_found": """
        with newest as (select model_name, text_hash, arg_max(dim, created_at) as dim, arg_max(vector, created_at) as v from dense_embedding_cache where text_hash is not null and model_name is not null and created_at is not null group by 1, 2),
        usable as (select model_name, text_hash, v::double[] as v from newest where len(v) = dim and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x != 0)) > 0),
        pairs as (select a.model_name, a.text_hash, b.text_hash as neighbour_hash, list_cosine_similarity(a.v, b.v) as s
            from usable a join usable b on a.model_name = b.model_name and len(a.v) = len(b.v) and a.text_hash != b.text_hash),
        ranked as (select *, row_number() over (partition by model_name, text_hash order by s desc, neighbour_hash) as n from pairs)
        select model_name, text_hash, neighbour_hash from ranked where n <= 5 and s >= 0.8""",
    "p6_found": r"""
        with words as (select chunk_id, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}_]+') as w from chunk_fts where chunk_id is not null and text is not null group by chunk_id),
        runs as (select distinct chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as r from (select chunk_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 20)),
        sizes as (select chunk_id, count(*) as n from runs group by 1),
        shared as (select a.chunk_id as a, b.chunk_id as b, count(*) as n from runs a join runs b on a.r = b.r and a.chunk_id < b.chunk_id group by 1, 2)
        select a as chunk_id_a, b as chunk_id_b from shared s join sizes x on x.chunk_id = a join sizes y on y.chunk_id = b where s.n >= 0.7 * (x.n + y.n - s.n) - 1e-9""",
    "p6_groups": r"""
        with recursive words as (select chunk_id, regexp_extract_all(lower(any_value(text_for_embedding)), '[\p{L}\p{N}_]+') as w from chunk_fts where chunk_id is not null and text_for_embedding is not null group by chunk_id),
        runs as (select chunk_id, r, count(*) as n from (select chunk_id, array_to_string(w[i:i + 4], ' ') as r from (select chunk_id, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 20)) group by 1, 2),
        bags as (select chunk_id, md5(string_agg(r || '#' || n, '|' order by r)) as h, sum(n) as size from runs group by 1),
        classes as (select *, min(chunk_id) over (partition by h) as rep from bags),
        reps as (select runs.* from runs join classes using (chunk_id) where chunk_id = rep),
        shared as (select a.chunk_id as a, b.chunk_id as b, sum(least(a.n, b.n)) as s from reps a join reps b on a.r = b.r and a.chunk_id < b.chunk_id group by 1, 2),
        near as (select a, b from shared join bags x on x.chunk_id = a join bags y on y.chunk_id = b where s >= 0.8 * (x.size + y.size - s) - 1e-9),
        edges as (select a, b from near union all select b, a from near),
        reach as (select chunk_id as node, chunk_id as label from classes where chunk_id = rep union select b, label from reach join edges on a = node),
        groups as (select node, min(label) as group_id from reach group by 1),
        degree as (select a, count(*) as links from edges group by 1)
        select chunk_id as id, group_id, coalesce(links, 0) as links from classes join groups on node = rep left join degree on a = rep""",
    "p8_check": r"""
        with k as (select container_kind, max(capacity_tokens)::bigint as c from pack_capacity where container_kind is not null and capacity_tokens > 0 group by 1),
        d as (select doc_id, greatest(coalesce(n_tokens, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'))), 0)::bigint as n from documents where doc_id is not null)
        select container_kind, count(*) as documents, sum(greatest(cast(ceil(n / c::double) as bigint), 1))::bigint as pieces, sum(n)::bigint as tokens, 0::bigint as overfull from k, d group by 1""",
}
