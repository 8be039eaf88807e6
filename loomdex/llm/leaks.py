"""Evaluation texts leaking into training text, also with other numbers and names.

Texts become words that spelling, markup and line layout do not change. In a template, numbers, names and
units are typed placeholders. Windows of template words are hash-joined; a window whose slots hold the same
values is a verbatim leak. Windows at one distance between text and passage belong together: where the slots of
all of them map one to one onto other values, they are a re-parameterised leak.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.bagminhash import mix
from loomdex.sources.shared import shared_table

FILTER_WINDOWS = 4_000_000  # windows of the cases (8 bytes each) up to which documents are filtered by them before the join
PLAIN_LEAST = 6  # words outside slots that a re-parameterised window needs
WORDS_KEPT = 500_000

# Units that follow a number.
UNITS = frozenset("ms sec min h kb mb gb tb kib mib gib px pt em mm cm m km mg g kg t l ml hz khz mhz ghz w kw v a percent usd eur gbp rub uah руб грн коп шт кг км мб гб мс сек мин".split())

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
# what a tag holds after its name: attributes, however long; or, so near its end, anything
_HELD = r"(?:(?:\s++[\w:.@-]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>]++))?+)*+\s*+/?>|(?:\s[^<>]{0,500})?/?>)"
_BLOCK = re.compile(r"<!--.*?-->|</?(?:br|p|div|li|ul|ol|td|th|tr|table|h[1-6]|hr|pre|blockquote)\b" + _HELD, re.I | re.S)
_INLINE = re.compile(r"</?[A-Za-z][\w:-]*+" + _HELD)
_WORD = re.compile(r"[^\W_]+")
# what may stand before a line and holds words: numbers of lines or items, dates, times, levels
_PREFIX = re.compile(
    r"^[ \t>#*/|;\-\[\]]*(?:(?:\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?(?:[.,]\d+)?Z?)?|\d\d:\d\d(?::\d\d)?(?:[.,]\d+)?|(?:DEBUG|INFO|NOTICE|WARN|WARNING|ERROR)\b|\d{1,6}(?=[ \t]*[.:)|\]>\t]|[ \t]{2,})|[a-zA-Z](?=[.)]))[ \t.:)|\]>\-]*)+",
    re.M,
)
_CAMEL = re.compile(r"[a-z][A-Z]|[A-Za-z]\d|\d[A-Za-z]")


def plain(text: str) -> str:
    """The text without invisible characters, entities and tags, in composed form."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    if "<" in text:
        text = _INLINE.sub("", _BLOCK.sub(" ", text))
    return text


def forms(text: str) -> list[list[str]]:
    """The words as written, once with every line whole and, where lines have such, once without their prefixes."""
    text = plain(text)
    whole = _WORD.findall(text)
    bare = _PREFIX.sub("", text)
    return [whole] if len(bare) == len(text) else [whole, _WORD.findall(bare)]


def folded(word: str) -> str:
    return word.casefold().replace("ё", "е")


def is_name(word: str) -> bool:
    return bool(_CAMEL.search(word))


class Templates:
    """Template and exact hashes of words. `names` and `plain_words`: what the cases' passages hold."""

    def __init__(self, names: frozenset[str], plain_words: frozenset[str], window: int):
        self.names, self.plain_words, self.window = names, plain_words, window
        self.known: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int]:
        w = folded(word)
        kind = "#" if w.isnumeric() else "%" if w in UNITS else "@" if w in self.names or (w not in self.plain_words and is_name(word)) else w
        return xxhash.xxh64_intdigest(kind), xxhash.xxh64_intdigest(w, 1), kind != w

    def hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of every window: the template's hash and the exact one."""
        if len(words) < self.window:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        t, e = [], []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = self._word(w)
            t.append(h[0])
            e.append(h[1])
        return self._rolled(t), self._rolled(e)

    def _rolled(self, hashes: list[int]) -> np.ndarray:
        h = np.array(hashes, dtype=np.uint64)
        n = len(h) - self.window + 1
        out = h[:n]
        for i in range(1, self.window):
            out = mix(out) + h[i : i + n]
        return mix(out).view(np.int64)

    def slots(self, words: list[str]) -> list[str]:
        return [folded(w) for w in words if self.known[w][2]]


def _windows(batches: Iterator[pd.DataFrame], templates: Templates, wanted: np.ndarray | None) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, text in zip(pdf["id"], pdf["text"], strict=True):
            for form, words in enumerate(forms(text)):
                t, e = templates.hashes(words)
                if wanted is None:
                    hits = np.arange(len(t))
                else:
                    at = np.minimum(np.searchsorted(wanted, t), len(wanted) - 1)
                    hits = np.nonzero(wanted[at] == t)[0] if len(wanted) else []
                out += [(key, t[i], e[i], templates.slots(words[i : i + templates.window]), form, int(i)) for i in hits]
        yield pd.DataFrame(out, columns=["id", "template", "exact", "slots", "form", "at"])


def leaks(documents: DataFrame, cases: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 12) -> DataFrame:
    """id_column, case_id, kind (verbatim, reparameterised), windows: how many windows of the case the document holds.

    verbatim: at least `window` consecutive words of the passage. reparameterised: windows equal but for
    numbers, names and units, each value of which stands for one other value throughout them, with at least
    PLAIN_LEAST other words in each; given only where the same document and case have no verbatim window. NULL ids
    and texts take no part, passages shorter than the window can't leak; repeated rows count once.

    The passages' vocabulary goes to the driver and to every task: it is bounded by the cases, which are test
    material, not by the corpus. Beyond FILTER_WINDOWS windows the documents are not filtered before the join.
    """
    spark = documents.sparkSession
    passages = cases.select("case_id", "passage").where("case_id is not null and passage is not null")
    vocabulary = passages.mapInPandas(_vocabulary, "word string, name boolean").groupBy("word").agg(F.max("name").alias("name")).toPandas()
    names = frozenset(vocabulary["word"][vocabulary["name"].astype(bool)])
    templates = spark.sparkContext.broadcast((names, frozenset(vocabulary["word"]) - names))
    schema = "template bigint, exact bigint, slots array<string>, form int, at int"
    held = passages.select(F.col("case_id").alias("id"), F.col("passage").alias("text")).mapInPandas(
        lambda it: _windows(it, Templates(*templates.value, window), None), f"id {passages.schema['case_id'].dataType.simpleString()}, {schema}"
    )
    held = held.withColumnRenamed("id", "case_id").withColumnRenamed("slots", "case_slots").withColumnRenamed("exact", "case_exact").withColumnRenamed("form", "case_form").withColumnRenamed("at", "case_at").distinct()
    held = shared_table(held, "p9-cases")  # read for the filter and for the join
    distinct = held.select("template").distinct()
    few = distinct.limit(FILTER_WINDOWS + 1).count() <= FILTER_WINDOWS
    wanted = spark.sparkContext.broadcast(np.sort(distinct.toPandas()["template"].to_numpy(dtype=np.int64)) if few else None)
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("id is not null and text is not null")
    found = texts.mapInPandas(
        lambda it: _windows(it, Templates(*templates.value, window), wanted.value), f"id {texts.schema['id'].dataType.simpleString()}, {schema}"
    ).join(held, "template")
    exact = F.col("exact") == F.col("case_exact")
    kept = found.where(exact | (F.size("slots") <= window - PLAIN_LEAST))
    pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("slots", "case_slots"))))  # as many as a passage has words at most
    together = kept.groupBy("id", "case_id", "form", "case_form", (F.col("at") - F.col("case_at")).alias("apart")).agg(F.max(exact).alias("verbatim"), F.collect_set("template").alias("templates"), pairs.alias("pairs"))
    # a value of one side stands for one of the other: as many pairs as distinct values on either side
    one_to_one = (F.size("pairs") == F.size(F.array_distinct("pairs.slots"))) & (F.size("pairs") == F.size(F.array_distinct("pairs.case_slots")))
    out = together.where(F.col("verbatim") | one_to_one).groupBy("id", "case_id").agg(F.max("verbatim").alias("verbatim"), F.size(F.array_distinct(F.flatten(F.collect_set("templates")))).cast("long").alias("windows"))
    kind = F.when(F.col("verbatim"), "verbatim").otherwise("reparameterised")
    return out.select(F.col("id").alias(id_column), "case_id", kind.alias("kind"), "windows")


def _vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = {w for text in pdf["passage"] for form in forms(text) for w in form}
        yield pd.DataFrame([(folded(w), is_name(w)) for w in words], columns=["word", "name"])
