"""Retrieval quality: all cases in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import case_prefix, contains_all, contains_any, contains_none, rate, search_language

LISTS = ("path_contains_any", "path_contains_all", "path_not_contains", "text_contains_any", "text_contains_all", "text_not_contains")


def normalised_cases(cases: DataFrame) -> DataFrame:
    """case_id, query, group, id_prefix, filter_lang, limit, and the six lists (empty where NULL)."""
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(f"expected.{n}"), empty).alias(n) for n in LISTS]
    group = F.coalesce(F.nullif(F.trim("case_group"), F.lit("")), F.lit("ungrouped"))
    limit = F.when(F.coalesce("max_results", F.lit(0)) > 0, F.col("max_results")).otherwise(F.lit(10))
    return cases.where("case_id is not null").select("case_id", F.coalesce("query", F.lit("")).alias("query"), group.alias("group"), case_prefix(F.col("case_id")).alias("id_prefix"), search_language(F.col("filters.lang")).alias("filter_lang"), limit.alias("limit"), *lists)


def evaluate(cases: DataFrame, results: DataFrame) -> DataFrame:
    """One row per case: first_rank, path_rank (NULL for none), hits at 5 and 10, top paths.

    cases as normalised; results: case_id, rank, path, text. A rank counts where all six lists agree; a case
    without any list never hits. The path's rank takes the three path lists and is NULL where these are empty.
    """
    asked = F.greatest(*[F.size(n) for n in LISTS]) > 0
    path_asked = F.greatest(*[F.size(n) for n in LISTS[:3]]) > 0
    within = results.select("case_id", "rank", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    joined = cases.join(within, "case_id", "left").where(F.col("rank").isNull() | (F.col("rank") <= F.col("limit")))
    path, text = F.col("path"), F.col("text")
    path_ok = contains_any(path, F.col(LISTS[0])) & contains_all(path, F.col(LISTS[1])) & contains_none(path, F.col(LISTS[2]))
    text_ok = contains_any(text, F.col(LISTS[3])) & contains_all(text, F.col(LISTS[4])) & contains_none(text, F.col(LISTS[5]))
    found = F.col("rank").isNotNull()
    ranks = joined.groupBy("case_id").agg(
        F.min(F.when(found & asked & path_ok & text_ok, F.col("rank"))).alias("first_rank"),
        F.min(F.when(found & path_asked & path_ok, F.col("rank"))).alias("path_rank"),
        F.count("rank").alias("results"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "path")))), lambda x: x["path"]).alias("top_paths"),
    )
    out = cases.join(ranks, "case_id", "left")
    hit = lambda column, n: F.coalesce(F.col(column) <= n, F.lit(False))
    return out.select(
        "case_id", "query", "group", "id_prefix", "filter_lang", "first_rank", "path_rank", F.coalesce("results", F.lit(0)).alias("results"), hit("first_rank", 5).alias("hit_at_5"), hit("first_rank", 10).alias("hit_at_10"), hit("path_rank", 5).alias("path_hit_at_5"), hit("path_rank", 10).alias("path_hit_at_10"), F.coalesce("top_paths", F.array().cast("array<string>")).alias("top_paths")
    )


_HITS = ("hit_at_5", "hit_at_10", "path_hit_at_5", "path_hit_at_10")


def totals(rows: DataFrame) -> DataFrame:
    """Counts and rates over all cases; zeros for none."""
    counts = rows.agg(F.count("*").alias("total"), *[F.coalesce(F.count_if(h), F.lit(0)).alias(h) for h in _HITS])
    return counts.select("total", *_HITS, *[rate(F.col(h), F.col("total")).alias(f"{h}_rate") for h in _HITS])


def summaries(rows: DataFrame) -> DataFrame:
    """dimension (group, id_prefix, filter_lang), value, counters and rates, in one pass by grouping sets; NULL and empty values are "unknown"."""
    named = rows.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c) for c in ("group", "id_prefix", "filter_lang")], *_HITS)
    sets = named.groupingSets([["group"], ["id_prefix"], ["filter_lang"]], "group", "id_prefix", "filter_lang")
    counted = sets.agg(F.grouping_id().alias("gid"), F.count("*").alias("total"), *[F.count_if(h).alias(h) for h in _HITS])
    dimension = F.when(F.col("gid") == 3, "group").when(F.col("gid") == 5, "id_prefix").otherwise("filter_lang")
    return counted.select(dimension.alias("dimension"), F.coalesce("group", "id_prefix", "filter_lang").alias("value"), "total", *_HITS, *[rate(F.col(h), F.col("total")).alias(f"{h}_rate") for h in _HITS])


def failed(rows: DataFrame) -> DataFrame:
    return rows.where("not hit_at_10")
