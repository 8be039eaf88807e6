import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.functions.paths import canonical_hash, canonical_path
from loomdex.functions.vector import cosine, dot, l2


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_and_lines(spark):
    assert column(spark, [" \u00a0a b\t\n", "", None], T.strip) == ["a b", "", None]
    texts = ["a\nb\r\nc\x0bd", "a\n", "", "a\u2028b\n\n"]
    assert column(spark, texts, T.lines) == [t.splitlines() for t in texts]


def test_words_and_terms(spark):
    assert column(spark, ["Ёлка a_b, c-d 7"], T.words) == [["Ёлка", "a_b", "c", "d", "7"]]
    assert column(spark, ["The the a CAT cat_2"], T.query_terms) == [["the", "cat", "cat_2"]]
    assert column(spark, [["A", "b", "a", "B"]], T.first_spellings, "array<string>") == [["A", "b"]]


def test_languages(spark):
    assert column(spark, ["/x/A.PHP", "a.ts", "b.vue", "README", ".md", "x.unknown"], T.language_of) == ["php", "typescript", "vue", "text", "text", "text"]
    assert column(spark, ["js", "JS", " jsx ", "ts", "tsx", "md", "yml", "php", "vue", " ", None], T.search_language) == ["javascript"] * 3 + ["typescript"] * 2 + ["markdown", "yaml", "php", "vue", None, None]


def test_uuid5_equals_the_standard_one(spark):
    names = ["a:/x.php:1", "источник:/путь:22", ""]
    assert column(spark, names, T.uuid5) == [str(uuid.uuid5(T.NAMESPACE, n)) for n in names]


def test_truncation(spark):
    assert column(spark, ["abc  def", "abc"], lambda x: T.truncated(x, 5)) == ["abc\n...<truncated>", "abc"]


def test_contains(spark):
    rows = spark.createDataFrame([("Lib/Path.php", ["LIB", "zzz"]), ("x", []), ("x", None), (None, ["a"])], "t string, n array<string>")
    got = rows.select(T.contains_any(F.col("t"), F.col("n")), T.contains_all(F.col("t"), F.col("n")), T.contains_none(F.col("t"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (True, True, True), (True, True, True), (False, False, True)]


def test_case_prefix(spark):
    assert column(spark, ["php_mail_1", "chat_7", "x", "", None], T.case_prefix) == ["php_mail", "chat", "x", "unknown", "unknown"]


def test_path_filters(spark):
    paths = ["modules/Lib/a_b.php", "modules/lib/axb.php", "МОДУЛЬ/x.php", "lib.php"]
    assert column(spark, paths, lambda x: T.path_like(x, "LIB/A_B")) == [True, True, False, False]
    assert column(spark, paths, lambda x: T.path_like(x, "модуль")) == [False] * 4
    assert column(spark, paths, lambda x: T.path_words_match(x, "php lib")) == [True, True, False, True]


@pytest.mark.parametrize(
    "pattern,yes,no",
    [
        ("vendor/", ["vendor/a", "x/vendor/b"], ["vendors/a", "vendor"]),
        ("*.min.js", ["a.min.js", "x/y.min.js"], ["a.js", "min.js"]),
        ("/docs/*.md", ["docs/a.md"], ["x/docs/a.md", "docs/b/a.md"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["b", "xa/b"]),
        ("file?.[ch]", ["file1.c", "x/file2.h"], ["file12.c", "file1.d"]),
    ],
)
def test_ignore_patterns(spark, pattern, yes, no):
    assert column(spark, yes + no, lambda x: T.ignored(x, [pattern])) == [True] * len(yes) + [False] * len(no)


def test_a_later_pattern_takes_back(spark):
    assert column(spark, ["a/x.php", "a/keep.php"], lambda x: T.ignored(x, ["a/*", "!a/keep.php", "# remark", ""])) == [True, False]


def test_canonical_path(spark):
    given_ = ["\\srv\\a\\b.php", "//srv//a/./b.php", "/srv/x/../a/b.php", "/srv/a/b.php", "/../srv/a/b.php", "a/../../b", None, "/srv/a..b/.env", "/srv/.a/..."]
    want = ["/srv/a/b.php"] * 5 + ["b", None, "/srv/a..b/.env", "/srv/.a/..."]
    assert column(spark, given_, canonical_path) == want


def test_canonical_hash(spark):
    assert column(spark, ["sha256:AB12", "AB12", "{SHA256}ab12", "sha-256-ab12", " ", None], canonical_hash) == ["ab12"] * 4 + [None, None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", ".", "..", "", "d"]), max_size=7))
def test_canonical_path_follows_segments(spark, parts):
    import posixpath

    path = "/" + "/".join(parts)
    want = posixpath.normpath(path).replace("//", "/")
    assert column(spark, [path], canonical_path) == [want]


def test_vector_measures(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = rows.select(cosine(F.col("a"), F.col("b")), dot(F.col("a"), F.col("b")), l2(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx(0.96) and got[0][1] == 24.0 and got[0][2] == pytest.approx(2**0.5)
    assert got[1][0] is None
