import random
import time

import pytest

from loomdex.operators import chunking as C
from loomdex.operators.chunking import ChunkConfig


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def random_texts(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc дё \t") for _ in range(rng.randint(0, 30)))
    return ["\n".join(word() for _ in range(rng.randint(0, 25))) + ("\n" if rng.random() < 0.5 else "") for _ in range(n)]


@pytest.mark.parametrize("config", [ChunkConfig(40, 10), ChunkConfig(20, 0), ChunkConfig(25, 24), ChunkConfig(30, 99)])
def test_fold_and_arrow_pack_alike(spark, config):
    table = docs(spark, [*random_texts(25), "", None, "x" * 95, "a\n" + "y" * 50 + "\nb", "a\r\nb\r\n"])
    key = lambda df: sorted(map(tuple, df.select("doc_id", "ordinal", "start_line", "end_line", "chunk").collect()))
    assert key(C.pack_lines(table, "doc_id", config)) == key(C.pack_lines_sql(table, "doc_id", config))


def test_the_fold_takes_long_texts(spark):
    """Its time follows the length of a text; when it followed the square, these took minutes."""
    config = ChunkConfig(1200, 150)
    texts = ["ab\n" * 20000, "z" * 1_000_000, "".join("é" * (i % 7) + "\n" for i in range(1500)) + "😀" * 3000, "\n" * 700]
    began = time.time()
    got = sorted(map(tuple, C.pack_lines_sql(docs(spark, texts), "doc_id", config).collect()))
    assert time.time() - began < 45
    assert got == sorted(map(tuple, C.pack_lines(docs(spark, texts), "doc_id", config).collect()))
    assert len(got) > 800


def test_overlap_keeps_at_least_one_line():
    parts = C.split_lines("aaaaaaaa\nbbbbbbbb\ncccccccc\n", ChunkConfig(20, 3))
    assert parts == [("aaaaaaaa\nbbbbbbbb\n", 1, 2), ("bbbbbbbb\ncccccccc\n", 2, 3)]


def test_a_huge_line_is_cut_without_overlap():
    parts = C.split_lines("ab\n" + "z" * 25 + "\ncd", ChunkConfig(10, 2))
    assert [p[0] for p in parts] == ["ab\n", "z" * 10, "z" * 10, "z" * 5 + "\n", "cd"]
    assert [p[1:] for p in parts] == [(1, 1), (2, 2), (2, 2), (2, 2), (3, 3)]


def test_blank_chunks_keep_their_number(spark):
    out = C.pack_lines(docs(spark, ["a" * 9 + "\n" + " " * 9 + "\n" + "b" * 9]), "doc_id", ChunkConfig(10, 0)).collect()
    assert [(r["ordinal"], r["chunk"]) for r in out][0] == (1, "a" * 9)
    assert out[-1]["ordinal"] > len(out) - 1


def test_windows(spark):
    out = C.chunk_windows(docs(spark, ["abcdefghij", "abc", "", None, "ab        "]), ChunkConfig(4, 1))
    got = {}
    for r in out.orderBy("doc_id", "ordinal").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert got == {0: ["abcd", "defg", "ghij"], 1: ["abc"], 4: ["ab"]}


def test_headings(spark):
    text = "intro\n# A\nx\n### not\n```\n# inside\n```\n## B\ny\n"
    out = C.chunk_headings(docs(spark, [text, "", None]), "doc_id", ChunkConfig(1000, 0)).orderBy("ordinal").collect()
    assert [(r["start_line"], r["end_line"], r["chunk"].split("\n")[0]) for r in out] == [(1, 1, "intro"), (2, 5, "# A"), (6, 7, "# inside"), (8, 9, "## B")]


def test_config_guards():
    with pytest.raises(ValueError):
        ChunkConfig(0, 0).checked()
    assert ChunkConfig(10, 10).checked().overlap_chars == 2


def test_router(spark):
    rows = [("s", "/r/a.md", "a.md", "markdown", "# T\nx"), ("s", "/r/a.php", "a.php", "php", "<?php\nfunction f()\n{\n    return 1;\n}\n"), ("s", "/r/a.js", "a.js", "javascript", "let a = 1;\n"), ("s", "/r/a.txt", "a.txt", None, "words")]
    out = {r["path"]: r for r in C.chunk_files(spark.createDataFrame(rows, "source_name string, path string, rel_path string, language string, text string")).collect()}
    assert set(out) == {"/r/a.md", "/r/a.php", "/r/a.js", "/r/a.txt"}
    assert "Lines:" not in out["/r/a.md"]["text_for_embedding"] and "Lines: 1-1" in out["/r/a.js"]["text_for_embedding"]
    assert "Symbol: function f" in out["/r/a.php"]["text_for_embedding"]


def test_without_overlap_no_line_repeats(spark):
    assert C.split_lines("aaaa\nbbbb\ncccc\n", ChunkConfig(10, 0)) == [("aaaa\nbbbb\n", 1, 2), ("cccc\n", 3, 3)]
    texts = [t for t in random_texts(30, seed=9) if t.strip()]
    for t in texts:
        assert "".join(p for p, _, _ in C.split_lines(t, ChunkConfig(25, 0))) == t


def packed_by_hand(text, most, overlap):
    """Line by line."""
    pieces, held = [], []
    for n, row in enumerate([r for r in text.split("\n")], 1):
        row += "\n" if n <= text.count("\n") else ""
        if not row:
            continue
        if len(row) > most:
            pieces += ([("".join(r for _, r in held), held[0][0], held[-1][0])] if held else []) + [(row[i : i + most], n, n) for i in range(0, len(row), most)]
            held = []
            continue
        if held and sum(len(r) for _, r in held) + len(row) > most:
            pieces.append(("".join(r for _, r in held), held[0][0], held[-1][0]))
            while held and (overlap == 0 or (len(held) > 1 and sum(len(r) for _, r in held) > overlap)):
                held.pop(0)
        held.append((n, row))
    return pieces + ([("".join(r for _, r in held), held[0][0], held[-1][0])] if held else [])


@pytest.mark.parametrize("config", [ChunkConfig(40, 10), ChunkConfig(20, 0), ChunkConfig(25, 24), ChunkConfig(60, 5)])
def test_packing_equals_a_line_by_line_version(config):
    for text in [*random_texts(200, seed=4), "", "\n", "x" * 95, "a\n" + "y" * 50 + "\nb", "\n\n\n" * 30]:
        assert C.split_lines(text, config) == packed_by_hand(text, config.max_chars, config.overlap_chars)


def test_a_file_that_cannot_be_chunked_stops_no_other(spark, monkeypatch):
    rows = [("s", "/a.php", "a.php", "php", "<?php\nfunction f() { }\n"), ("s", "/b.txt", "b.txt", "text", "fine\n")]
    table = spark.createDataFrame(rows, "source_name string, path string, rel_path string, language string, text string")
    from loomdex.operators.code import CodeConfig

    broken = {"php": CodeConfig(chunk=ChunkConfig(0, 0), fallback="none")}
    out = {r["path"]: r for r in C.chunk_files(table, broken, faults=True).collect()}
    assert out["/a.php"]["chunk"] is None and out["/a.php"]["fault"].startswith("ValueError") and out["/b.txt"]["fault"] is None
    assert [r["path"] for r in C.chunk_files(table, broken).collect()] == ["/b.txt"]
