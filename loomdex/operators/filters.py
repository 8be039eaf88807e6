"""Scopes of a search: column predicates in conjunction, pushed to the scan where they are equalities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import ALIASES, path_like, path_words_match


def normalised_language(name: str | None) -> str | None:
    plain = (name or "").strip().casefold()
    return ALIASES.get(plain, plain) or None


# how each restriction becomes a predicate, given the form in which paths are compared
PREDICATES = {
    "source": lambda value, form: F.col("source_name") == value,
    "lang": lambda value, form: F.col("language") == value,
    "source_type": lambda value, form: F.col("source_type") == value,
    "path": lambda value, form: {"words": path_words_match, "like": path_like}[form](F.col("rel_path"), value),
}


class Scope(dict):
    """Restrictions by the names of PREDICATES; blank values restrict nothing, a language may have any of its names."""

    def __init__(self, **wanted: str | None):
        unknown = set(wanted) - set(PREDICATES)
        if unknown:
            raise TypeError(f"unknown restrictions: {', '.join(sorted(unknown))}")
        wanted["lang"] = normalised_language(wanted.get("lang"))
        super().__init__({name: value for name, value in wanted.items() if value})

    def predicates(self, path_form: str = "words") -> list[Column]:
        return [PREDICATES[name](value, path_form) for name, value in sorted(self.items())]

    def apply(self, chunks: DataFrame, path_form: str = "words") -> DataFrame:
        """Chunks that fit. `path_form`: "words" (every word of it occurs in rel_path) or "like" (part of rel_path, with wild cards)."""
        return reduce(DataFrame.where, self.predicates(path_form), chunks)
