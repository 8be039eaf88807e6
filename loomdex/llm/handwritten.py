"""Generated, minified, vendored and data-only source files.

Character trigram models of identifiers, one per language, are counted over the whole collection. A file's
identifiers are scored with its language's model: mangled names stand out by their cross-entropy, template
output by names without diversity, and copies of others' code by names in a foreign style or namespace.
What the names tell comes first. Marks that tools and third parties leave (comments, folders, namespaces) come
after, for files whose names look like the project's own, and file names where there are too few names to judge.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.sources.shared import shared_table

LEAST_NAMES = 30  # a file with fewer is not judged by its names
LEAST_FILES = 20  # of a language with fewer such files no usual cost is known: there the share of one-letter names decides
SHORT_SHARE = 0.45
CHUNK_NAMES = 40  # a chunk weighs no more names in the model than this, lest one bundle teaches it its own
DATA_SHARE = 0.75
# A file stands out from its language where it is off the median by SPREADS times the distance of median and
# lower quartile (the upper half holds the outliers), and by these at least; the mean cost of few names varies
# by chance, so it has to be off by FEW_NAMES / sqrt(names) more:
SPREADS = 6
FEW_NAMES = 3.0
OUTLYING_BITS = 0.6
OUTLYING_DIVERSITY = 0.12
OUTLYING_STYLE = 0.25

# What tools and third parties leave in comments, file names and folders.
_GENERATED = re.compile(
    r"(?im)^[ \t]*(?:<\?php[ \t]*)?(?://+|/?\*+!?|#+|;+|--|<!--|/\*+)[ \t]*.*?(?:@generated\b|<auto-generated|(?:file|code|class|module|source)\b.{0,30}\b(?:is|was|are)\b.{0,20}\bauto(?:matically)?[- ]?generated|\bauto-?generated (?:by|from|file)|\bcode generated by\b|\bgenerated by .{1,60}(?:do not|don't|on \d|from\b|;)|\b(?:any )?(?:manual )?changes? (?:is|are|will be) (?:lost|overwritten)|\bdo not (?:edit|modify)\b.{0,12}\boutput of\b|\bregenerate with\b|maschinell erstellt|automatisch (?:erzeugt|generiert|erstellt)|сгенерировано (?:из|с помощью|автоматически)|создан[оа]? автоматически|перезаписывается при|правки будут потеряны|згенеровано|створено автоматично|перезаписується|généré automatiquement|ne pas modifier à la main|generado automáticamente|no (?:editar|modificar) a mano)"
)
_THIRD = re.compile(
    r"(?im)^[ \t]*(?:<\?php[ \t]*)?(?://+|/?\*+!?|#+|<!--|/\*+!?)[ \t]*.*?(?:\((?:c|C)\)\s*\d{4}.{0,60}\b(?:contributors|authors|foundation|project)\b|\breleased under the\b|\blicen[sc]ed? under\b|\bcopyright\b.{0,60}\blicen[sc]e:|\bupstream:|@license\b|\b[a-z][\w.-]+ v\d+\.\d+\.\d+\b(?!.*\brelease\b))"
)
_FOLDERS = r"(?i)(?:^|/)(?:vendors?|node_modules|bower_components|jspm_packages|third[_-]?party|3rd[_-]?party|external|externals|libs?-3rd|lib-external)/"
_FILES = r"(?i)(?:[.-]min\.(?:js|css|mjs)|\.bundle\.(?:js|mjs|css)|\.chunk\.js|\.(?:js|css|ts)\.map|\.map|[.-][0-9a-f]{8,20}\.(?:js|css|mjs))$|(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|[^/]*\.lock|[^/]*[.-]lock\.(?:json|ya?ml)|go\.sum)$"
_NAMESPACE = re.compile(r"(?m)^[ \t]*namespace[ \t]+\\?([A-Za-z_]\w*)")
_IDENTIFIER = re.compile(r"(?<![\w$])[A-Za-z_$][\w$]*", re.A)
_MARKUP = re.compile(r"\?>.*?(?=<\?|\Z)", re.S)
_TAG = re.compile(r"<\?|\?>")
_BLOB = re.compile(r"[A-Za-z0-9+/=]{40,}")
# Words of the languages themselves, which nobody chose.
_KEYWORDS = frozenset(
    "php abstract and array as async await bool boolean break callable case catch class clone const continue debugger declare default delete die do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum exit export extends false final finally float fn for foreach from function get global goto if implements import in include include_once instanceof insteadof int interface isset let list match mixed namespace never new null number object of or parent print private protected public readonly require require_once return self set static string super switch this throw trait true try type typeof undefined unset use var void while with xor yield any".split()
)
_NOISE = re.compile(r"/\*.*?\*/|(?m:(?://|#(?!\[)).*$)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", re.S)
_DATA = re.compile(r"0x[0-9A-Fa-f]+|\b\d+(?:\.\d+)?\b|[A-Za-z0-9+/=]{40,}|\\x[0-9A-Fa-f]{2}")

_CLASS = np.zeros(256, dtype=np.int32)  # 0 ends a name
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
    _CLASS[_c] = 1 + _i
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    _CLASS[_c] = 27 + _i
for _c in b"0123456789":
    _CLASS[_c] = 53
_CLASS[ord("_")], _CLASS[ord("$")] = 54, 55
SIZE = 56
# The languages of the names models, by extension, and those of prose. Any other is "text".
CODE = {"php": "php", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "vue": "vue"}
PROSE = {"html": "html", "htm": "html", "md": "markdown", "txt": "text"}


def trigrams(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of the names in turn (two marks before, one after), and where each name begins."""
    c = _CLASS[np.frombuffer(("  " + "  ".join(names) + " ").encode("ascii"), dtype=np.uint8)]
    code = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
    starts = np.cumsum([0, *[len(n) + 2 for n in names[:-1]]])
    return code, starts


def names_in(text: str, language: str) -> list[str]:
    """The identifiers in turn, without comments, strings, keywords, long encoded runs and, in PHP, the markup between its tags."""
    if language == "php":
        tag = _TAG.search(text)
        if tag:  # a chunk may begin inside PHP or inside markup
            text = _MARKUP.sub(" ", text[tag.start() :] if tag[0] == "<?" else text)
    return [n for n in _IDENTIFIER.findall(_BLOB.sub(" ", _NOISE.sub(" ", text))) if n.lower() not in _KEYWORDS]


class NameModel:
    """Bits of every trigram's last character, from the counts of one language."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        counts = np.zeros(SIZE**3)
        counts[code] = n
        table = counts.reshape(SIZE * SIZE, SIZE) + 0.02
        self.bits = -np.log2(table / table.sum(axis=1, keepdims=True)).ravel().astype(np.float32)

    def cost(self, names: list[str]) -> np.ndarray:
        """Bits a character of each name."""
        code, starts = trigrams(names)
        sums = np.add.reduceat(self.bits[code], starts)
        return sums / np.array([len(n) + 1 for n in names])


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for language, part in pdf.groupby("lang"):
            n = np.zeros(SIZE**3)
            for text in part["text"]:
                names = sorted(set(names_in(text, language)))
                if names:
                    code, _ = trigrams(names)
                    np.add.at(n, code, min(1.0, CHUNK_NAMES / len(names)))
            code = np.flatnonzero(n)
            if len(code):
                n = n[code]
                out.append(pd.DataFrame({"lang": language, "code": code, "n": n}))
        yield pd.concat(out) if out else pd.DataFrame({"lang": [], "code": [], "n": []})


def name_models(chunks: DataFrame) -> dict[str, NameModel]:
    """A model per language of CODE over all chunks; at most SIZE**3 counts of each reach the driver."""
    counted = chunks.where(F.col("lang").isin(*set(CODE.values()))).mapInPandas(_counts, "lang string, code int, n double").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    return {language: NameModel(part["code"].to_numpy(), part["n"].to_numpy()) for language, part in counted.groupby("lang")}


def _features(batches: Iterator[pd.DataFrame], models: dict[str, NameModel]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for chunk, source, path, rel_path, language, text in zip(pdf["chunk"], pdf["source_name"], pdf["path"], pdf["rel_path"], pdf["lang"], pdf["text"], strict=True):
            code = language in models
            names = names_in(text, language) if code else []
            lines = text.count("\n") + 1
            short = snake = 0
            bits = 0.0
            if names:
                # text of another language under the extension is no mangled text
                bits = min(float(m.cost(names).sum()) for m in models.values())
                short = sum(1 for n in names if len(n) == 1)
                snake = sum(1 for n in names if "_" in n[1:-1] and n.islower())
            data = sum(len(m) for m in _DATA.findall(text)) if code else 0
            namespace = _NAMESPACE.search(text) if language == "php" else None
            marks = (1 if _GENERATED.search(text) else 0) | (2 if _THIRD.search(text) else 0)
            solid = sum(1 for c in text if not c.isspace() and c not in ",;[](){}'\"=>\\") if data * 3 > len(text) else 0
            out.append((chunk, source, path, rel_path, language, marks, namespace[1] if namespace else None, len(text), lines, len(names), sorted(zlib.crc32(n.encode()) for n in set(names)), bits, short, snake, data, solid, bool("$MESS" in text)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")])


_SCHEMA = "chunk bigint, source_name string, path string, rel_path string, lang string, marks int, namespace string, chars bigint, lines bigint, names bigint, kinds array<bigint>, bits double, short bigint, snake bigint, data bigint, solid bigint, messages boolean"


def classify_files(chunks: DataFrame) -> DataFrame:
    """source_name, path, kind, and the measures it rests on: one row per file of chunk_fts.

    kind: lock_or_map, generated, vendored, minified, data, or handwritten. The language is that of the path's
    extension where the column is blank. Rows with NULL source or path name no file, a NULL text is empty;
    repeated chunks count once; other columns are ignored.
    """
    spark = chunks.sparkSession
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    by_name = F.create_map(*[F.lit(x) for pair in (CODE | PROSE).items() for x in pair])
    named = F.lower(F.trim("language"))
    language = F.coalesce(by_name[extension], F.when(named.isin(*{*CODE.values(), *PROSE.values()}), named), F.lit("text"))
    rows = (
        chunks.where("source_name is not null and path is not null")
        .select("source_name", "path", F.coalesce("rel_path", "path").alias("rel_path"), language.alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("chunk_id", "text").alias("chunk"))
    )
    models = spark.sparkContext.broadcast(name_models(rows.select("lang", "text")))
    features = rows.mapInPandas(lambda it: _features(it, models.value), _SCHEMA).distinct()
    sums = [F.sum(c).alias(c) for c in ("chars", "lines", "names", "bits", "short", "snake", "data", "solid")]
    files = features.groupBy("source_name", "path").agg(
        F.min("rel_path").alias("rel_path"), F.min("lang").alias("lang"), F.bit_or("marks").alias("marks"), F.min(F.lower("namespace")).alias("namespace"), F.bool_or("messages").alias("messages"), *sums,
        F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))).cast("long").alias("kinds"),
    )
    files = shared_table(files, "p4-files")  # one row a file: read for the limits, for the teams and for the answer
    # the teams that module paths name are the project's own
    team = F.lower(F.coalesce(F.nullif(F.regexp_extract("rel_path", r"(?:^|/)modules/([A-Za-z0-9]+)\.", 1), F.lit("")), F.nullif(F.regexp_extract("rel_path", r"^components/([A-Za-z0-9]+)/", 1), F.lit(""))))
    own = files.select(team.alias("namespace")).where("namespace is not null").distinct().withColumn("own", F.lit(True))
    files = files.join(own, "namespace", "left")
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    # names repeat the more the longer a file is, so diversity is the exponent that the distinct ones grow with
    diversity = F.log("kinds") / F.log("names")
    quarter = lambda c, least: F.percentile_approx(F.when(F.col("names") >= least, c), [0.25, 0.5], 10_000)
    usual = files.groupBy("lang").agg(quarter(part("bits", "names"), LEAST_NAMES).alias("bits_q"), quarter(diversity, 100).alias("diversity_q"), quarter(part("snake", "names"), LEAST_NAMES).alias("style_q"), F.count_if(F.col("names") >= LEAST_NAMES).alias("judged"))
    off = lambda c, least: F.greatest(F.lit(least), SPREADS * (F.get(c, F.lit(1)) - F.get(c, F.lit(0))))
    limits = usual.select(
        "lang", "judged", (F.get("bits_q", F.lit(1)) + off("bits_q", OUTLYING_BITS)).alias("most_bits"), (F.get("diversity_q", F.lit(1)) - off("diversity_q", OUTLYING_DIVERSITY)).alias("least_diversity"),
        (F.get("style_q", F.lit(1)) + off("style_q", OUTLYING_STYLE)).alias("most_snake"),
    )
    files = files.join(F.broadcast(limits), "lang")  # a row for each language of CODE and PROSE at most
    path = F.col("rel_path")
    many = F.col("names") >= LEAST_NAMES
    kind = (
        F.when(path.rlike(_FILES) & ~path.rlike(r"(?i)\.(?:js|mjs|css)$"), "lock_or_map")
        .when(many & (F.col("judged") >= LEAST_FILES) & (part("bits", "names") > F.col("most_bits") + FEW_NAMES / F.sqrt("names")), "minified")
        .when(many & (F.col("judged") < LEAST_FILES) & (part("short", "names") >= SHORT_SHARE) & (part("chars", "lines") > 60), "minified")
        .when(many & (part("snake", "names") > F.col("most_snake")), "vendored")
        .when((F.col("names") >= 100) & (diversity < F.col("least_diversity")), "generated")
        .when((F.col("solid") > 0) & ~F.col("messages") & (F.col("chars") >= 300) & (part("data", "solid") >= DATA_SHARE) & (part("data", "chars") >= DATA_SHARE / 2), "data")
        .when(F.col("marks").bitwiseAND(1) > 0, "generated")
        .when(path.rlike(_FOLDERS) | (F.col("marks").bitwiseAND(2) > 0) | (F.col("namespace").isNotNull() & F.col("own").isNull()), "vendored")
        .when(~many & path.rlike(_FILES), "minified")
        .otherwise("handwritten")
    )
    return files.select("source_name", "path", kind.alias("kind"), "lang", "chars", "names", part("bits", "names").alias("bits"), part("kinds", "names").alias("diversity"), part("data", "chars").alias("data"))
