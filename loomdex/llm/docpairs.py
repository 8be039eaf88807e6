"""Functions paired with their documentation.

Comment spans and function spans come from independent tables. An as-of join gives every function the last
doc comment that ends above it; comments with a statement in between are rejected, and so are comments that
say nothing beyond the function's name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Descriptions that stand in for one, in the words left when markup and signs are gone.
PLACEHOLDERS = frozenset(
    """
    description|desc|summary|summary here|short description|long description|description here|add description|enter description|enter description here|method description|function description|no description|no description available|no description provided|missing description|doc|docs|docblock|documentation|todo|todo describe|todo description|todo document|todo docs|todo write|fixme|fixme describe|fixme description|tbd|xxx|n a|na|none|null|undocumented|created by the file template|generated by the file template|created by phpstorm|auto generated|auto generated method stub|lorem ipsum|placeholder|stub|here be docs|write me|comment|comment here|your description here|some description|see above|see below|see parent|inherited|inherit|inheritdoc|inherit doc|same as parent
    описание|описание метода|описание функции|описание класса|краткое описание|введите описание|добавить описание|без описания|нет описания|заглушка|заглушка описания|метод класса|функция класса|комментарий|описать|todo описать|todo описание|документация|тут описание|здесь описание|см выше|наследуется
    опис|опис методу|опис функції|без опису|введіть опис|додати опис|заглушка опису|метод класу
    beschreibung|keine beschreibung|kurzbeschreibung|beschreibung einfügen|beschreibung hier|description à compléter|sans description|aucune description|à compléter|à documenter|sin descripción|descripción|descripción aquí|por documentar
    """.replace("\n", "|").split("|")
) - {""}
PLACEHOLDERS = frozenset(p.strip() for p in PLACEHOLDERS)
# Words of stock phrases round a name, and kinds.
STOCK = frozenset(
    """
    a an the this that it its is are was be been being used use uses useful helper to for of and or by in on with from as do does done can will shall
    implements implement implementation implementing performs perform performing executes execute handles handle handling provides provide method methods function functions func fn class trait interface constructor destructor routine procedure callback public protected private static abstract final simple simply just returns return gets get sets set here call calls called
    метод метода методом функция функции функцию функцией класса класс трейт этот эта это данный данная для реализует реализация реализации выполняет выполнение используется служит предназначен предназначена нужен нужна вызов вызывает конструктор и
    методу функція функції клас класу цей ця це реалізує реалізація виконує виконання використовується призначений призначена конструктор та
    die der das dieser diese dieses methode funktion klasse ist wird zum zur für von implementiert führt aus verwendet und
    la le les cette ce méthode fonction classe est utilisée utilisé pour de du des sert implémente et l d
    el los las esta este método metodo función funcion clase es se usa usado usada para del implementa y
    """.split()
)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_INLINE = re.compile(r"\{@(\w+)([^{}]*)\}")
_WORD = re.compile(r"[^\W_]+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\dA-Za-z_]+")


def parts(name: str) -> list[str]:
    """The words of a name in camel or snake case, in lower case."""
    return [p.lower() for p in _PART.findall(name)]


def plain_description(description: str | None) -> str:
    """Without tags, inline doc tags, entities and marks of markup."""
    text = html.unescape(description or "")
    text = _INLINE.sub(lambda m: "inheritdoc" if m[1].lower() == "inheritdoc" else m[2], text)
    text = re.sub(r"@(inheritdoc)\b", r"\1", text, flags=re.I)
    return re.sub(r"\s+", " ", re.sub(r"[*`#>|_~]+(?=\s|$)|(?:(?<=\s)|^)[*`#>|_~]+", " ", _TAG.sub(" ", text))).strip()


def _same_word(word: str, part: str) -> bool:
    """Whether a word is a form of a name's part: inflected in its ending only."""
    if word == part:
        return True
    stem = part[:-1] if len(part) > 3 and part[-1] in "ey" else part
    return len(stem) >= 3 and word.startswith(stem) and word[len(stem) :] in ("s", "es", "ys", "ying", "ed", "d", "ing", "e", "er", "ers", "ies", "ied", "al", "tion", "ation", "y", stem[-1] + "ing", stem[-1] + "ed", stem[-1] + "er")


def says_nothing(description: str | None, name: str, kind: str) -> bool:
    """Whether a description is empty, a placeholder, an inherit mark, or the name or kind in other form or a stock phrase round it."""
    text = plain_description(description)
    words = [w.lower() for w in _WORD.findall(text)]
    if not words or " ".join(words) in PLACEHOLDERS or set(words) <= {"inheritdoc", "todo", "fixme"}:
        return True
    named = parts(name)
    left = [p for w in _WORD.findall(text) for p in (parts(w) or [w.lower()])]
    left = [w for w in left if w not in STOCK and w != kind.lower() and not any(_same_word(w, p) for p in named)]
    if not left:
        return True
    return " ".join(left) in PLACEHOLDERS and not any(_same_word(w, p) for w in words for p in named)


def as_of_comments(symbols: DataFrame, comments: DataFrame) -> DataFrame:
    """Every function or method with a body, and the last comment of its file that ends above its first line."""
    keys = ["source_name", "path"]
    usable = "source_name is not null and path is not null and start_line is not null"
    s = symbols.where(f"{usable} and name is not null and has_body").where(F.lower("kind").isin("function", "method"))
    s = s.select(*keys, F.lower("kind").alias("kind"), "name", "parent_name", "start_line", "end_line", "start_byte", "end_byte").distinct()
    c = comments.where(f"{usable} and end_line is not null").groupBy(*keys, "start_line", "end_line").agg(F.max(F.struct(F.coalesce("description", F.lit("")).alias("description"), F.to_json("tags").alias("tags"))).alias("d"))
    both = s.select(*keys, F.col("start_line").alias("at"), F.lit(0).alias("order"), F.struct("kind", "name", "parent_name", "start_line", "end_line", "start_byte", "end_byte").alias("symbol"), F.lit(None).alias("comment")).unionByName(
        c.select(*keys, F.col("end_line").alias("at"), F.lit(1).alias("order"), F.lit(None).alias("symbol"), F.struct(F.col("start_line").alias("first"), F.col("end_line").alias("last"), "d.description", "d.tags").alias("comment"))
    )
    order = W.partitionBy(*keys).orderBy("at", "order", F.col("comment.first")).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = both.withColumn("comment", F.last("comment", ignorenulls=True).over(order)).where("symbol is not null and comment is not null")
    return near.select(*keys, "symbol.*", "comment.*")


_OUT = "source_name string, path string, kind string, name string, parent_name string, start_line int, end_line int, description string, tags string, code string"


def documented_functions(symbols: DataFrame, comments: DataFrame, files: DataFrame) -> DataFrame:
    """source_name, path, kind, name, parent_name, start_line, end_line, description, tags (JSON), code.

    One row per function or method with a body whose nearest doc comment ends above it with only blank lines
    between and says something. Repeated rows count once; of comments at the same lines the one with the
    greatest description counts; files without text give no rows, NULL descriptions are empty.
    """
    near = as_of_comments(symbols, comments)
    fields = [c for c in near.columns if c not in ("source_name", "path")]
    # a file's functions travel together, so that its text is read and split once
    by_file = near.groupBy("source_name", "path").agg(F.collect_list(F.struct(*fields)).alias("pairs"))
    texts = files.where("text is not null").groupBy("source_name", "path").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, path, pairs, text in zip(pdf["source_name"], pdf["path"], pdf["pairs"], pdf["text"], strict=True):
                lines, data = text.split("\n"), None
                for p in pairs:
                    between = lines[p["last"] : p["start_line"] - 1]
                    after = lines[p["last"] - 1].rpartition("*/")[2] if 0 < p["last"] <= len(lines) else ""
                    if any(line.strip() for line in between) or after.strip() or says_nothing(p["description"], p["name"], p["kind"]):
                        continue
                    data = data if data is not None else text.encode()
                    if p["start_byte"] is not None and p["end_byte"] is not None:
                        code = data[p["start_byte"] : p["end_byte"]].decode(errors="replace")
                    else:
                        code = "\n".join(lines[p["start_line"] - 1 : p["end_line"]])
                    out.append((source, path, p["kind"], p["name"], p["parent_name"], p["start_line"], p["end_line"], plain_description(p["description"]), p["tags"], code))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return texts.join(by_file, ["source_name", "path"]).mapInPandas(run, _OUT)
