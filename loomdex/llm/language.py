"""Language of documents and of their segments, by compression.

Each language has zstandard raw-content dictionaries made of a bounded, documented sample of labelled
documents. A segment's language is the one whose dictionary makes its words smallest; a narrow margin is
rejected. Labels are unreliable, so the sample is first relabelled by word counts and only
segments that their words confirm make the dictionaries.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LANGUAGES = ("en", "ru", "uk", "de", "fr", "es")
SAMPLE_DOCUMENTS = 250  # labelled documents of each language that the dictionaries are made of
SAMPLE_CHARACTERS = 20_000  # of one sampled document; classification reads whole texts
DICTIONARY_BYTES = 24_576
LEVEL = 3
MARGIN = 0.03
RATIO = 0.95  # natural text in a known language gets smaller than this; code and names do not
LEAST_WORDS = 6
HELD_OUT, STEPS = 1_000, 8  # sampled segments that calibrate the confidence, and its steps
PIECE = 4_000  # characters compressed at a time: a dictionary saves about as many bytes in a longer text, so the margin would shrink

# Spellings of the languages' names.
SPELLINGS = {
    "en": "en eng english", "ru": "ru rus russian", "uk": "uk ukr ukrainian ua", "de": "de deu ger german",
    "fr": "fr fra fre french", "es": "es spa spanish castilian",
}
UNDETERMINED = ("", "xx", "und", "mul", "zxx", "mis", "unknown", "undetermined", "none", "null", "n/a", "na", "auto", "??", "?", "-")

# Cyrillic letters in Latin ones.
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ'’"
_RU = "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya yo i yi ye g  ".split(" ")
_UK = "a b v h d e zh z y i k l m n o p r s t u f kh ts ch sh shch  y  e yu ya yo i yi ye g  ".split(" ")
_BY_RU = dict(zip(_CYRILLIC, _RU, strict=True))
_BY_UK = dict(zip(_CYRILLIC, _UK, strict=True))
_KEPT = {c: v for c, v in _BY_RU.items() if c not in "іїєґ"}  # a table for Russian applied to Ukrainian
_SHORT = {"х": "h", "й": "j", "ц": "c", "ю": "ju", "я": "ja"}
LATIN = {"ru": (_BY_RU, _BY_RU | _SHORT), "uk": (_BY_UK, _KEPT)}

_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"(?<![\w$@/\\.>:-])(?:[^\W\d_]['’]?)+(?![\w/\\(]|[.:>-]+\w)")
_CAMEL = re.compile(r"[a-zа-я][A-ZА-Я]")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_CODE_IN = re.compile(r"->|=>|::|\$\w|\)\s*[{;]|[;{}]\s*$")
_CODE_AT = re.compile(
    r"\s*(?:#\d+\s|at\s+[\w.$<>\\/]+\(|File \"|Traceback|Caused by|[{}\[\]<]|[\w.\"'-]+\s*[=:]\s*[\w\"'\[{/.-]+[,;]?\s*$"
    r"|(?:SELECT|INSERT|UPDATE|DELETE|CREATE)\b.*\b(?:FROM|INTO|SET|TABLE)\b|[+|]-|(?:[$%]|npm|git|php|composer|sudo|cd)\s[\w./-]+ )"
)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")


def natural_words(lines: list[str]) -> str:
    """The words of the lines that read as prose, in lower case; identifiers, numbers and paths left out."""
    kept = [line for line in lines if not _CODE_AT.match(line) and not _CODE_IN.search(line)]
    text = " ".join(kept)
    if "<" in text:
        text = _TAG.sub("", text)
    return " ".join(w if w.islower() else w.lower() for w in _LETTERS.findall(text) if not (len(w) > 2 and _CAMEL.search(w)))


def segments(text: str) -> Iterator[tuple[int, list[str], int]]:
    """(number from 1, lines outside fences, words of these) of each block between blank lines."""
    number, lines, fenced, filled = 0, [], False, False
    for line in [*text.split("\n"), ""]:
        if line.strip():
            filled = True
            if _FENCE.match(line):
                fenced = not fenced
            elif not fenced:
                lines.append(line)
        elif filled:
            number += 1
            yield number, lines, len(_WORD.findall(" ".join(lines)))
            lines, filled = [], False


def latin(text: str, language: str) -> list[str]:
    """The text as typed without the language's own letters, in each usual way."""
    if language in LATIN:
        return ["".join(table.get(c, c) for c in text) for table in LATIN[language]]
    return ["".join(c for c in unicodedata.normalize("NFD", text.replace("ß", "ss")) if not unicodedata.combining(c))]


def in_pieces(words: str) -> Iterator[str]:
    """The words in parts of at most about PIECE characters, equally long, none of them cut."""
    length = -(-len(words) // max(1, -(-len(words) // PIECE)))
    at = 0
    while at < len(words):
        end = words.find(" ", at + length)
        end = len(words) if end < 0 or len(words) - end < length // 2 else end
        yield words[at:end]
        at = end


def is_cyrillic(text: str) -> bool:
    """Whether most letters take two bytes in UTF-8, which for the six languages means Cyrillic ones."""
    return len(text.encode()) > 1.4 * len(text)


@dataclass
class Model:
    """Raw dictionary contents by script and language; compressors are made once in each process."""

    contents: dict[bool, dict[str, bytes]]
    right: list[tuple[float, float]] = field(default_factory=list)  # margins, ascending, and the share of held-out segments with such margins that were labelled right
    _made: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"contents": self.contents, "right": self.right, "_made": {}}

    def confidence(self, margin: float) -> float:
        """The share of segments with such a margin that are labelled right, as far as held-out ones tell; without these the margin itself."""
        if not self.right:
            return min(1.0, margin)
        margins, shares = zip(*self.right, strict=True)
        return float(np.interp(margin, margins, shares))

    def classify(self, words: str) -> tuple[str | None, float, float]:
        """Best language (None: no dictionary), margin to the second, compressed size against the size."""
        cyrillic = is_cyrillic(words)
        if cyrillic not in self._made:
            self._made[cyrillic] = {
                language: zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False
                )
                for language, content in self.contents[cyrillic].items()
                if content
            }
        pieces = [piece.encode() for piece in in_pieces(words)]
        sizes = sorted((sum(len(c.compress(data)) - 8 for data in pieces), language) for language, c in self._made[cyrillic].items())
        length = sum(map(len, pieces))
        if not sizes:
            return None, 0.0, 1.0
        first = max(1, sizes[0][0])
        second = sizes[1][0] if len(sizes) > 1 else length
        return sizes[0][1], (second - first) / max(first, second, 1), first / max(1, length)


def fit(sample: dict[str, list[str]], rounds: int = 4) -> Model:
    """sample: words of segments by label. Wrong labels are few in each language: segments move to the label whose
    word counts explain them best (naive Bayes, repeated), and the dictionaries are made of those that are clear."""
    held = [(label, words, sorted(set(words.split(" ")))) for label, texts in sorted(sample.items()) for words in sorted(set(texts))]
    # words as typed in Latin letters speak for the language whose letters they stand for
    typed = [sorted({w for t in latin(text, label) for w in t.split(" ")} - set(words)) if label not in LATIN or is_cyrillic(text) else [] for label, text, words in held]
    now = [label for label, _, _ in held]
    clear = [True] * len(held)
    for _ in range(rounds):
        counts: dict[str, Counter] = {language: Counter() for language in LANGUAGES}
        for label, sure, (named, _, words), more in zip(now, clear, held, typed, strict=True):
            if sure:
                counts[label].update(words)
                if label == named:
                    counts[label].update(more)
        size = {language: sum(c.values()) for language, c in counts.items()}
        known = {language for language in LANGUAGES if size[language]}
        for i, (_, _, words) in enumerate(held):
            score = sorted(((sum(math.log((counts[k][w] + 0.1) / (size[k] + 1000.0)) for w in words), k) for k in known), reverse=True)
            now[i] = score[0][1]
            clear[i] = len(score) < 2 or score[0][0] - score[1][0] > 2.0 + 0.5 * len(words)
    clean: dict[str, list[str]] = {language: [] for language in LANGUAGES}
    for label, sure, (_, text, _) in zip(now, clear, held, strict=True):
        if sure:
            clean[label].append(text)
    model = _model(clean)
    model.right = calibrated(clean)
    return model


def calibrated(clean: dict[str, list[str]]) -> list[tuple[float, float]]:
    """Of clean segments every fifth, by hash, is held out (HELD_OUT at most) and classified by dictionaries of the others: margins and
    shares of right labels in STEPS of equally many, one counted right and one wrong for each step, never falling."""
    apart = {label: [t for t in texts if xxhash.xxh64_intdigest(t, 5) % 5 == 0] for label, texts in clean.items()}
    model = _model({label: [t for t in texts if xxhash.xxh64_intdigest(t, 5) % 5] for label, texts in clean.items()})
    asked = sorted(((xxhash.xxh64_intdigest(t), label, t) for label, texts in apart.items() for t in texts))[:HELD_OUT]
    told = sorted((margin, found == label) for label, (found, margin, _) in ((label, model.classify(t)) for _, label, t in asked))
    if len(told) < 10 * STEPS:
        return []
    out: list[tuple[float, float]] = []
    for part in np.array_split(np.array(told), STEPS):
        share = (part[:, 1].sum() + 1) / (len(part) + 2)
        out.append((float(part[:, 0].mean()), max(share, out[-1][1]) if out else float(share)))
    return out


def _model(sample: dict[str, list[str]]) -> Model:
    contents: dict[bool, dict[str, bytes]] = {True: {}, False: {}}
    for language in LANGUAGES:
        texts = sample.get(language, [])
        if language in LATIN:
            own = [t for t in texts if is_cyrillic(t)]
            contents[True][language] = _content(own)
            contents[False][language] = _content([x for t in own for x in latin(t, language)])
        else:
            own = [t for t in texts if not is_cyrillic(t)]
            contents[False][language] = _content([x for t in own for x in dict.fromkeys((t, *latin(t, language)))])
    return Model(contents)


def _content(texts: list[str]) -> bytes:
    """Texts in turn until the dictionary is full; new words are worth more than texts seen often."""
    out, size, seen = [], 0, set()
    for t in sorted(set(texts), key=lambda t: (xxhash.xxh64_intdigest(t), t)):
        words = t.split(" ")
        if not seen.issuperset(words):
            seen.update(words)
            data = t.encode()
            out.append(data)
            size += len(data)
            if size >= DICTIONARY_BYTES:
                break
    return b"\n".join(out)[:DICTIONARY_BYTES]


def named_language(label: Column) -> Column:
    """The language a label names: one of LANGUAGES, another label as it is, or NULL for none."""
    plain = F.lower(F.trim(label))
    first = F.regexp_extract(plain, r"^([^\s_\-]*)", 1)
    spelled = F.create_map(*[F.lit(x) for language, names in SPELLINGS.items() for name in names.split() for x in (name, language)])
    return F.when(plain.isin(*UNDETERMINED) | first.isin("xx", "und", "mul", "zxx"), None).otherwise(F.coalesce(spelled[first], plain))


def train(documents: DataFrame, id_column: str, text_column: str, label_column: str) -> Model:
    """Dictionaries of at most SAMPLE_DOCUMENTS documents of each language (those of least hash)."""
    named = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), named_language(F.col(label_column)).alias("label"))
    named = named.where(F.col("label").isin(*LANGUAGES) & F.col("text").isNotNull() & (F.length("text") > 40))
    counts = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return _model({})
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, SAMPLE_DOCUMENTS / n))])
    drawn = named.where((F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1_000_003)) / 1_000_003.0) < share[F.col("label")])
    sample: dict[str, list[str]] = {}
    nth = F.row_number().over(W.partitionBy("label").orderBy("least", "id"))  # about SAMPLE_DOCUMENTS rows of a language each
    least = drawn.select("label", "id", F.xxhash64(F.lit(11), "id").alias("least"), F.substring("text", 1, SAMPLE_CHARACTERS).alias("text")).withColumn("nth", nth).where(F.col("nth") <= 2 * SAMPLE_DOCUMENTS)
    for r in least.orderBy("label", "nth").collect():
        for _, lines, n in segments(r["text"]):
            words = natural_words(lines)
            if n >= LEAST_WORDS and words.count(" ") >= 3:
                sample.setdefault(r["label"], []).append(words)
    return fit(sample)


def label_segments(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", model: Model | None = None) -> DataFrame:
    """id_column, segment_no, words, language, confidence, named: one row for each segment with prose.

    Segments are the blocks between blank lines, all counted from 1. Fenced blocks, traces, code and
    segments of fewer than LEAST_WORDS words get no row. language is NULL where the margin is narrow or no
    dictionary fits. confidence: the share of held-out sample segments right at such a margin of the second best compression, 0..1. named: the language
    that `label_column` names, NULL for none. NULL ids and texts give no rows.
    """
    spark = documents.sparkSession
    model = model or train(documents, id_column, text_column, label_column)
    shipped = spark.sparkContext.broadcast(model)
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), named_language(F.col(label_column)).alias("named")).where("id is not null and text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text, named in zip(pdf["id"], pdf["text"], pdf["named"], strict=True):
                for number, lines, n in segments(text):
                    if n < LEAST_WORDS:
                        continue
                    words = natural_words(lines)
                    if words.count(" ") < 2:
                        continue
                    language, margin, ratio = shipped.value.classify(words)
                    sure = language is not None and margin >= MARGIN and ratio <= RATIO
                    out.append((key, number, n, language if sure else None, shipped.value.confidence(margin) if sure else 0.0, named))
            yield pd.DataFrame(out, columns=[id_column, "segment_no", "words", "language", "confidence", "named"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"{id_column} {kind}, segment_no int, words int, language string, confidence double, named string")


def label_documents(labelled: DataFrame, id_column: str = "doc_id", documents: DataFrame | None = None) -> DataFrame:
    """id_column, language, confidence, mixed: the language with most words, its share weighted by confidence, and whether another has segments.

    With `documents`, each of their ids that is not NULL has a row: language NULL and confidence 0 where no segment
    has a language. Else only documents with such segments have one.
    """
    by = labelled.where("language is not null").groupBy(id_column, "language").agg(F.sum("words").alias("words"), F.sum(F.col("words") * F.col("confidence")).alias("weight"))
    all_words = F.sum("words")
    found = by.groupBy(id_column).agg(
        F.max_by("language", F.struct("words", "language")).alias("language"),
        (F.max_by("weight", F.struct("words", "language")) / all_words).alias("confidence"),
        (F.count("*") > 1).alias("mixed"),
    )
    if documents is None:
        return found
    every = documents.select(id_column).where(F.col(id_column).isNotNull()).distinct()
    return every.join(found, id_column, "left").select(id_column, "language", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("mixed", F.lit(False)).alias("mixed"))
