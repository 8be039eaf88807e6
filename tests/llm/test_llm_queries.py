"""Every query of the subpackage on the smallest tables: against SQL where there is some, else that it runs with its columns."""

from pathlib import Path

import pytest
from compare import assert_same, connection

from loomdex.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are absent")
COLUMNS = {
    "p1_found": ["model_name", "text_hash", "neighbour_hash"], "p3_found": ["chunk_id", "start_char"], "p4_found": ["source_name", "path"], "p5_found": ["source_name", "path", "name", "start_line"], "p6_found": ["chunk_id_a", "chunk_id_b"],
    "p7_found": ["source_name", "path"], "p9_found": ["doc_id", "case_id"], "p10_found": ["doc_id", "segment_no", "true_lang"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, FOLDER), queries.SQL[name], connection(FOLDER))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.columns == COLUMNS.get(name, df.columns)
    df.write.format("noop").mode("overwrite").save()
