"""Text functions as column expressions; one definition of lines, blanks and words for the whole engine."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://loomdex.invalid/chunks")

# Languages by file extension, and other names for languages in filters.
EXTENSIONS = {".php": "php", ".js": "javascript", ".ts": "typescript", ".vue": "vue", ".html": "html", ".md": "markdown"}
ALIASES = {"js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "md": "markdown", "yml": "yaml"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


# White space of any script.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(x, F.lit(BLANKS))


def rstrip(x: Column) -> Column:
    return F.rtrim(x, F.lit(BLANKS))


def lines(x: Column) -> Column:
    """Lines without their ends; a last empty one is none."""
    parts = F.split(x, BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines_with_ends(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


def words(x: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def query_terms(x: Column, limit: int = 16) -> Column:
    """Lower-cased words of two or more characters, each once in order of appearance, at most `limit`."""
    return F.slice(F.array_distinct(F.filter(words(F.lower(x)), lambda w: F.length(w) >= 2)), 1, limit)


def first_spellings(tokens: Column) -> Column:
    """Tokens that differ in more than case; the first spelling stays."""
    folded = F.transform(tokens, lambda t: F.lower(t))
    return F.filter(tokens, lambda t, i: F.array_position(folded, F.lower(t)) == i + 1)


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.coalesce(F.element_at(_map(EXTENSIONS), suffix), F.lit("text"))


def search_language(name: Column) -> Column:
    """A filter's language: stripped, lower-cased, aliases resolved; blank is NULL."""
    plain = F.nullif(F.lower(strip(name)), F.lit(""))
    return F.coalesce(F.element_at(_map(ALIASES), plain), plain)


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def truncated(text: Column, limit: int, mark: str = "\n...<truncated>") -> Column:
    return F.when(F.length(text) > limit, F.concat(rstrip(F.substring(text, 1, limit)), F.lit(mark))).otherwise(text)


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Version 5 UUID of a name, computed from SHA-1 without leaving the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 1
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant.substr(nibble, F.lit(1)), part(18, 3), F.lit("-"), part(21, 12))


def chunk_id(source: Column, path: Column, ordinal: Column) -> Column:
    """Stable across edits of the text; the source is part of it, so that equal paths of two sources stay apart."""
    return uuid5(F.concat_ws(":", source, path, ordinal.cast("string")))


def folded(x: Column) -> Column:
    """Lower case in which letters that differ in case only are equal, as `str.casefold`: ß is ss, ς is σ."""
    return F.replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def contains_any(text: Column, needles: Column) -> Column:
    """TRUE where the list is NULL or empty; letter case does not matter."""
    low = folded(F.coalesce(text, F.lit("")))
    return (F.size(F.coalesce(needles, F.array().cast("array<string>"))) == 0) | F.exists(needles, lambda n: F.contains(low, folded(n)))


def contains_all(text: Column, needles: Column) -> Column:
    low = folded(F.coalesce(text, F.lit("")))
    return F.coalesce(F.forall(needles, lambda n: F.contains(low, folded(n))), F.lit(True))


def contains_none(text: Column, needles: Column) -> Column:
    low = folded(F.coalesce(text, F.lit("")))
    return ~F.coalesce(F.exists(needles, lambda n: F.contains(low, folded(n))), F.lit(False))


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def case_prefix(case_id: Column) -> Column:
    """The first part of an id between underscores, two parts after "php"; "unknown" for none."""
    parts = F.split(case_id, "_")
    two = F.when((F.get(parts, F.lit(0)) == "php") & (F.size(parts) > 1), F.array_join(F.slice(parts, 1, 2), "_")).otherwise(F.get(parts, F.lit(0)))
    return F.coalesce(F.nullif(two, F.lit("")), F.lit("unknown"))


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_like(path: Column, pattern: str) -> Column:
    """`%` and `_` of the pattern are wild, as users of the lexical index expect; only ASCII letters fold."""
    return ascii_lower(path).like("%" + pattern.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) + "%")


def path_words_match(path: Column, query: str) -> Column:
    """Every word (2 to 64 characters) of the query is a word of the path."""
    wanted = [w for w in dict.fromkeys(re.findall(r"[^\W]+", query.lower())) if 2 <= len(w) <= 64]
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]).cast("array<string>"), words(F.lower(path)))) == 0


def glob_regex(pattern: str) -> str:
    """An ignore-file pattern as a regular expression over relative paths."""
    p = pattern.strip()
    anchored = "/" in p.rstrip("/")
    folder = p.endswith("/")
    p = p.strip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            end = p.index("]", i + 1)
            body = p[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(rel_path: Column, patterns: list[str]) -> Column:
    """Whether ignore-file patterns exclude a path; a later `!pattern` takes it back."""
    out = F.lit(False)
    for pattern in patterns:
        if not pattern.strip() or pattern.startswith("#"):
            continue
        keep = pattern.startswith("!")
        out = F.when(rel_path.rlike(glob_regex(pattern[1:] if keep else pattern)), F.lit(not keep)).otherwise(out)
    return out
