"""Source files that do not parse: faults per file, first cause, rates per source and language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.syntax import LANGUAGES, check
from loomdex.llm.syntax.base import TOO_DEEP

_OUT = "source_name string, path string, language string, valid boolean, first_cause string, first_line int, faults array<struct<line: int, cause: string>>"


def check_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """source_name, path, language, valid, first_cause, first_line, faults: one row for each php, js, ts and vue file behind `chunks`.

    The language is that of the path's extension, in any letter case. Texts come from `files`, since chunks
    overlap and may be missing; a NULL text is empty. Rows of `chunks` with NULL source or path name no
    file; repeated rows of either table count once (of several texts of one path the greatest); other
    columns are ignored. Where a text is nested deeper than the parser follows, `faults` ends with the cause
    "too deep"; valid is NULL then unless a fault is known.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    wanted = chunks.select("source_name", "path").where("source_name is not null and path is not null").where(extension.isin(*LANGUAGES)).distinct()
    texts = files.where(extension.isin(*LANGUAGES)).select("source_name", "path", F.coalesce("text", F.lit("")).alias("text"))
    known = texts.join(wanted, ["source_name", "path"], "left_semi").groupBy("source_name", "path").agg(F.max("text").alias("text"))  # the join's partitioning

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, path, text in zip(pdf["source_name"], pdf["path"], pdf["text"], strict=True):
                language = LANGUAGES[path.rsplit(".", 1)[1].lower()]
                faults = check(language, text)
                known_faults = [f for f in faults if f.cause != TOO_DEEP]
                first = (known_faults or faults or [None])[0]
                valid = False if known_faults else None if faults else True
                out.append((source, path, language, valid, first and first.cause, first and first.line, [tuple(f) for f in faults]))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", faults")[0].split(", ")] + ["faults"])
            yield frame.astype({"first_line": "Int32"})

    return known.mapInPandas(run, _OUT)


def rates(checked: DataFrame) -> DataFrame:
    """source_name, language, files, invalid, too_deep (neither valid nor invalid as far as is known), accepted: the share of files that parse."""
    bad = F.count_if(~F.col("valid"))
    return checked.groupBy("source_name", "language").agg(F.count("*").alias("files"), bad.alias("invalid"), F.count_if(F.col("valid").isNull()).alias("too_deep"), (F.count_if("valid") / F.count("*")).alias("accepted"))
