"""Queries of the incremental operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdex.operators.incremental import files_to_process
from loomdex.plans.tables import table

RUN = 9


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    tables = [table(spark, folder, t) for t in ("indexed_files", "index_runs", "file_scan")]
    return files_to_process(*tables, run_id=RUN).select("source_name", "path")


_PATH = r"regexp_replace(regexp_replace(regexp_replace(replace(path, '\', '/'), '/+', '/', 'g'), '(/\.)+(/|$)', '/', 'g'), '/[^/]+/\.\.(/|$)', '/', 'g')"
_HASH = r"regexp_replace(lower(trim(file_hash)), '^[a-z][a-z0-9-]*:', '')"

QUERIES = {"p2_found": p2_found}
SQL = {
    "p2_found": f"""
        with done as (
            select source_name, {_PATH} as path, {_HASH} as file_hash, indexed_at
            from indexed_files join (select distinct run_id, source_name from index_runs where status = 'ok') using (run_id, source_name)),
        state as (select source_name, path, arg_max(file_hash, (indexed_at, file_hash)) as file_hash from done group by 1, 2),
        seen as (select source_name, {_PATH} as path, {_HASH} as file_hash, scanned_at, scan_id
            from file_scan where run_id = {RUN} and file_hash is not null),
        source as (select source_name, path, arg_max(file_hash, (scanned_at, scan_id)) as file_hash from seen group by 1, 2)
        select source_name, path from source s
        where not exists (select 1 from state t where t.source_name = s.source_name and t.path = s.path and t.file_hash = s.file_hash)""",
}
