import pytest
from pyspark.sql import functions as F

from loomdex.functions.text import contains_all, contains_any, contains_none
from loomdex.operators.stats import Timings


def test_timings_add_up_in_their_order(spark):
    t = Timings()
    with t.of("other"):
        pass
    for _ in range(2):
        with t.of("chunk"):
            pass
    with pytest.raises(ValueError), t.of("scan"):
        raise ValueError
    found = t.table(spark).orderBy("position").collect()
    assert [r["bucket"] for r in found] == ["scan", "chunk", "other"] and all(r["seconds"] >= 0 for r in found) and len(t.events) == 4


def test_case_is_folded(spark):
    row = spark.createDataFrame([("STRASSE und ΛΌΓΟΣ", ["straße"], ["λόγος"], None)], "t string, a array<string>, b array<string>, n array<string>")
    got = row.select(contains_any(F.col("t"), F.col("a")), contains_all(F.col("t"), F.col("b")), contains_none(F.col("t"), F.col("a")), contains_any(F.col("t"), F.col("n"))).head()
    assert tuple(got) == (True, True, False, True)
