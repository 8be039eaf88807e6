"""Generators of chunks: fixed windows, packed lines with overlap, headings, and the router over languages.

Line packing exists twice: as a fold of SQL expressions over line lengths (`pack_lines_sql`) and as an Arrow
function (`pack_lines`), which is faster for long texts. Tests hold them to be equal. All Arrow functions carry
the file's columns along, so a text is read once and never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.memory import guard
from loomdex.functions.text import chunk_id, lines_with_ends, strip


@dataclass(frozen=True)
class ChunkConfig:
    max_chars: int = 2200
    overlap_chars: int = 250

    def checked(self) -> ChunkConfig:
        if self.max_chars <= 0:
            raise ValueError("max_chars must be above 0")
        if self.overlap_chars >= self.max_chars:
            return ChunkConfig(self.max_chars, self.max_chars // 5)
        return ChunkConfig(self.max_chars, max(0, self.overlap_chars))


# The sizes in use for each kind of text.
CONFIGS = {"markdown": ChunkConfig(1800, 200), "text": ChunkConfig(2200, 250), "code": ChunkConfig(2600, 300), "php": ChunkConfig(2600, 300)}
CODE_LANGUAGES = ("javascript", "typescript", "vue")
# Fixed value: lines that a fold of expressions takes at a time.
BLOCK = 256


def windows(text: Column, config: ChunkConfig) -> Column:
    """Overlapping windows of fixed width, stripped, blank ones dropped: a closed form, so no state is folded."""
    c = config.checked()
    n, step = F.length(text), c.max_chars - c.overlap_chars
    count = F.when(n <= c.max_chars, 1).otherwise(F.ceil((n - c.max_chars) / step).cast("int") + 1)
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: strip(F.substring(text, i * step + 1, F.lit(c.max_chars))))
    return F.filter(parts, lambda p: p != "")


def huge_line_slices(line: Column, width: int) -> Column:
    return F.when(F.length(line) > 0, F.transform(F.sequence(F.lit(0), F.length(line) - 1, F.lit(width)), lambda i: F.substring(line, i + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def chunk_windows(documents: DataFrame, config: ChunkConfig) -> DataFrame:
    """documents with ordinal (from 1) and chunk, one row per window; blank and NULL texts give none."""
    return documents.select("*", F.posexplode(windows(F.col("text"), config)).alias("n", "chunk")).withColumn("ordinal", F.col("n") + 1).drop("n")


def text_windows(text: str, config: ChunkConfig) -> list[str]:
    """As `windows`, of one text."""
    c = config.checked()
    step = c.max_chars - c.overlap_chars
    count = max(0, -(-(len(text) - c.max_chars) // step)) + 1
    return [w for w in (text[i * step : i * step + c.max_chars].strip() for i in range(count)) if w]


def split_headings(text: str, config: ChunkConfig) -> list[tuple[str, int, int]]:
    """(text, first line, last line) of the blocks that begin at `# ` or `## ` lines, long ones in windows.

    A fence does not hide a heading, `###` begins no block. Every part of a block carries the block's lines.
    """
    rows = text.splitlines()
    begins = sorted({0, *(i for i, row in enumerate(rows) if row.startswith(("# ", "## ")))})
    spans = [(first, last) for first, last in zip(begins, [*begins[1:], len(rows)], strict=True) if first < last]
    return [(part, first + 1, last) for first, last in spans for part in text_windows("\n".join(rows[first:last]).strip(), config)]


def chunk_headings(documents: DataFrame, key: str, config: ChunkConfig) -> DataFrame:
    """key, ordinal, start_line, end_line, chunk: `split_headings` of every text, numbered from 1; NULL and blank texts give none."""
    return _by_arrow(documents, key, lambda text: split_headings(text, config))


def packed_spans(sizes: Column, config: ChunkConfig) -> Column:
    """ARRAY<STRUCT<s, e>> of line numbers from 1 by a fold over line lengths; a line longer than max_chars is a span of its own.

    The buffer is always a run of lines, so the state is only its first line and its length. The fold goes block by
    block, as every append copies the array it extends. sizes is read several times a line: a column, no expression.
    """
    c = config.checked()
    n = F.size(sizes)
    spans = "array<struct<s:int,e:int>>"
    span = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    state = lambda out, st, cl: F.struct(out.alias("out"), st.cast("int").alias("st"), cl.cast("int").alias("cl"))
    none = F.lit(0)

    def flushed(a: Column, i: Column) -> Column:
        return F.when(a["st"] > 0, F.array_append(a["out"], span(a["st"], i - 1))).otherwise(a["out"])

    def carried(a: Column, i: Column) -> Column:
        """A new buffer of line i and the lines kept as overlap before it: from the end while they fit, at least one; none without overlap."""
        size = F.element_at(sizes, i)
        if not c.overlap_chars:
            return state(flushed(a, i), i, size)
        zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("t"), F.lit(False).alias("stop"))

        def keep(b: Column, j: Column) -> Column:
            t = b["t"] + F.element_at(sizes, j)
            full = b["stop"] | ((b["k"] > 0) & (t > c.overlap_chars))
            return F.struct(F.when(full, b["k"]).otherwise(b["k"] + 1).alias("k"), F.when(full, b["t"]).otherwise(t).alias("t"), (full | (t >= c.overlap_chars)).alias("stop"))

        # no line is empty, so no more than overlap_chars of them fit
        return F.aggregate(F.sequence(i - 1, F.greatest(a["st"], i - c.overlap_chars), F.lit(-1)), zero, keep, lambda b: state(flushed(a, i), i - b["k"], b["t"] + size))

    def step(a: Column, i: Column) -> Column:
        size = F.element_at(sizes, i)
        huge = state(F.array_append(flushed(a, i), span(i, i)), none, none)
        plain = state(a["out"], F.when(a["st"] > 0, a["st"]).otherwise(i), a["cl"] + size)
        return F.when(size > c.max_chars, huge).when((a["st"] > 0) & (a["cl"] + size > c.max_chars), carried(a, i)).otherwise(plain)

    def block(a: Column, k: Column) -> Column:
        rows = F.sequence(k * BLOCK + 1, F.least(n, (k + 1) * BLOCK))
        return F.aggregate(rows, state(F.array().cast(spans), a["st"], a["cl"]), step, lambda b: state(F.array_append(a["out"], b["out"]), b["st"], b["cl"]))

    def finish(a: Column) -> Column:
        return F.concat(F.flatten(a["out"]), F.when(a["st"] > 0, F.array(span(a["st"], n))).otherwise(F.array().cast(spans)))

    start = state(F.array().cast(f"array<{spans}>"), none, none)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), start, block, finish)).otherwise(F.array().cast(spans))


def pack_lines_sql(documents: DataFrame, key: str, config: ChunkConfig) -> DataFrame:
    """key, ordinal, start_line, end_line, chunk by expressions alone; blank chunks are dropped and keep their number.

    Pieces are made of the row's lines before they are exploded, so that no piece carries all lines along.
    """
    c = config.checked()
    split = documents.where("text is not null").select(key, lines_with_ends(F.col("text")).alias("ls"))
    sized = split.select(key, "ls", F.transform("ls", lambda x: F.length(x)).alias("sizes"))
    piece = lambda p, text: F.struct(p["s"].alias("s"), p["e"].alias("e"), strip(text).alias("chunk"))

    def pieces(p: Column) -> Column:
        slices = F.regexp_extract_all(F.element_at("ls", p["s"]), F.lit(f"(?s).{{1,{c.max_chars}}}"), F.lit(0))  # substrings would be sought from the line's begin, each
        whole = F.array_join(F.slice("ls", p["s"], p["e"] - p["s"] + 1), "")
        return F.when(F.element_at("sizes", p["s"]) > c.max_chars, F.transform(slices, lambda x: piece(p, x))).otherwise(F.array(piece(p, whole)))

    # the generator holds the expression itself: of a column, filters would be inferred that evaluate it again
    each = sized.select(key, F.posexplode(F.flatten(F.transform(packed_spans(F.col("sizes"), c), pieces))).alias("n", "p"))
    return each.select(key, (F.col("n") + 1).alias("ordinal"), F.col("p.s").alias("start_line"), F.col("p.e").alias("end_line"), F.col("p.chunk").alias("chunk")).where("chunk != ''")


def split_lines(text: str, config: ChunkConfig) -> list[tuple[str, int, int]]:
    """(text, first line, last line) of each piece, unstripped.

    A piece is a run of lines that ends where the next would make it longer than max_chars, or before a line that
    is longer alone, which is cut into slices. The next piece begins with as many of its last lines as fit into
    overlap_chars, one at least, if there is an overlap; after a cut line it begins anew.
    """
    c = config.checked()
    parts = text.split("\n")
    rows = [p + "\n" for p in parts[:-1]] + parts[-1:] * bool(parts[-1])
    ends = [0, *accumulate(map(len, rows))]  # ends[i]: characters before line i
    walls = [i for i, row in enumerate(rows) if len(row) > c.max_chars] + [len(rows)]
    out: list[tuple[str, int, int]] = []
    begin = 0
    for wall in walls:
        new = begin  # the first line that no piece holds yet
        while new < wall:
            end = min(wall, max(new + 1, bisect_right(ends, ends[begin] + c.max_chars) - 1))
            out.append((text[ends[begin] : ends[end]], begin + 1, end))
            tail = min(bisect_left(ends, ends[end] - c.overlap_chars), end - 1) if c.overlap_chars else end
            begin, new = max(begin, tail), end
        if wall < len(rows):
            out += [(text[at : min(at + c.max_chars, ends[wall + 1])], wall + 1, wall + 1) for at in range(ends[wall], ends[wall + 1], c.max_chars)]
        begin = wall + 1
    return out


def _by_arrow(documents: DataFrame, key: str, split) -> DataFrame:
    """key, ordinal, start_line, end_line, chunk of (text, first line, last line) pieces; blank ones are dropped and keep their number."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, n, s, e, part.strip()) for k, text in zip(pdf[key], pdf["text"], strict=True) for n, (part, s, e) in enumerate(split(text), 1) if part.strip()]
            yield pd.DataFrame(out, columns=[key, "ordinal", "start_line", "end_line", "chunk"])

    return documents.where("text is not null").select(key, "text").mapInPandas(run, f"{key} {kind}, ordinal int, start_line int, end_line int, chunk string")


def pack_lines(documents: DataFrame, key: str, config: ChunkConfig) -> DataFrame:
    """As `pack_lines_sql`, by Arrow batches; nothing is shuffled."""
    return _by_arrow(documents, key, lambda text: split_lines(text, config))


def headed(chunk: str, path: str, language: str, lines: tuple[int, int] | None) -> str:
    """The text for embedding: path, language and, if given, lines, a blank line, the chunk."""
    head = [f"Path: {path}", f"Language: {language}"] + ([f"Lines: {lines[0]}-{lines[1]}"] if lines else [])
    return "\n".join(head) + "\n\n" + chunk


FILE = "source_name string, path string, rel_path string, language string"
PIECE = "ordinal int, start_line int, end_line int, chunk string, text_for_embedding string"


def chunk_files(files: DataFrame, configs: dict | None = None, max_chunks_per_file: int | None = None, faults: bool = False, max_memory_mb: int | None = None) -> DataFrame:
    """The router: markdown by headings, php by its symbols, other code and text by lines.

    files: source_name, path, rel_path, language, text. Out: those but text, then ordinal, start_line, end_line,
    chunk, text_for_embedding, the columns of `code.PAYLOAD` (NULL but for php), chunk_id and content_hash. One
    pass over the files without a shuffle. `configs` by "markdown", "code" and "text" are ChunkConfigs, by "php"
    one or a CodeConfig. A file that can't be chunked stops no other: with `faults` it gives a row with `fault`
    and without a chunk, else none. NULL and blank texts give no rows.
    A worker that holds more than `max_memory_mb` ends the run.
    """
    from loomdex.operators import code

    configs = CONFIGS | (configs or {})
    php = configs["php"] if isinstance(configs["php"], code.CodeConfig) else code.CodeConfig(chunk=configs["php"])
    names = [c.split()[0] for c in f"{FILE}, {PIECE}".split(", ")] + code.names_of(code.PAYLOAD) + ["fault"]

    def pieces(path: str, rel_path: str, language: str, text: str) -> Iterator[dict]:
        if language == "php":
            yield from code.chunk_php(text, path, rel_path or path, php)
            return
        markdown = language == "markdown"
        split = split_headings if markdown else split_lines
        for n, (part, s, e) in enumerate(split(text, configs["markdown" if markdown else "code" if language in CODE_LANGUAGES else "text"]), 1):
            if part.strip():
                yield {"ordinal": n, "start_line": s, "end_line": e, "chunk": part.strip(), "text_for_embedding": headed(part.strip(), path, language or "text", None if markdown else (s, e))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            guard(max_memory_mb, "cutting files")
            out = []
            for source, path, rel, language, text in zip(*(pdf[c] for c in ("source_name", "path", "rel_path", "language", "text")), strict=True):
                file = {"source_name": source, "path": path, "rel_path": rel, "language": language}
                try:
                    out += [file | piece for piece in list(pieces(path, rel, language, text))[:max_chunks_per_file]]
                except Exception as e:
                    out.append(file | {"fault": f"{type(e).__name__}: {e}"})
            yield code.frame(out, names)

    rows = files.where("text is not null").select("source_name", "path", "rel_path", "language", "text").mapInPandas(run, f"{FILE}, {PIECE}, {code.PAYLOAD}, fault string")
    out = rows.withColumn("chunk_id", F.when(F.col("fault").isNull(), chunk_id(F.col("source_name"), F.col("path"), F.col("ordinal")))).withColumn("content_hash", F.sha2("text_for_embedding", 256))
    return out if faults else out.where("fault is null").drop("fault")
