"""Spellings of paths and hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """One spelling of a path: `/` as separator, no empty, `.` or `..` segments. NULL stays NULL.

    `..` above the root is dropped; of a relative path too, since such a path names nothing in a source.
    """
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(F.array_append(kept, part))

    walked = F.array_join(F.aggregate(F.split(flat, "/"), none, step), "/")
    full = F.when(flat.startswith("/"), F.concat(F.lit("/"), walked)).otherwise(walked)
    # most paths are in order already, and need no walk
    return F.when(flat.rlike(r"(^|/)\.{0,2}(/|$)") & ~flat.rlike(r"^/([^/]*[^/.][^/]*/)*[^/]*[^/.][^/]*$"), full).otherwise(flat)


def canonical_hash(digest: Column) -> Column:
    """Lower-case hex digits without an algorithm's prefix (`sha256:`, `sha256-`, `{sha256}`); a blank digest is NULL."""
    bare = F.regexp_replace(F.lower(F.trim(digest)), r"^\{?[a-z][a-z0-9-]*[:}=]|^sha-?[0-9]+-", "")
    return F.when(F.length(bare) > 0, bare)
