"""BM25 over an inverted index of positional postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions.text import query_terms
from loomdex.sources.shared import shared_table, small_side

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6  # of terms in half of the texts or more
MAX_TERMS = 16
SMALL_TERMS = 100_000  # asked terms that may be broadcast
FIELD_GAP = 1 << 24


def index_terms(text: Column) -> Column:
    """Terms of the index: runs of letters and digits (the underscore separates), lower-cased, Latin diacritics removed."""
    folded = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@dataclass
class LexicalIndex:
    """occurrences: term, id, pos, one row for each (of each field shifted apart); lengths: id, length; statistics: one row n, average.

    Postings of the terms that a search asks for are grouped from `occurrences` after a semi-join with these, unless
    `stored` ones are at hand: term, id, tf, positions.
    """

    occurrences: DataFrame | None
    lengths: DataFrame
    statistics: DataFrame
    stored: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        return grouped(self.occurrences) if self.stored is None else self.stored

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """The postings of a table of distinct terms."""
        terms = small_side(terms, SMALL_TERMS)
        if self.stored is not None:
            return self.stored.join(terms, "term", "left_semi")
        return grouped(self.occurrences.join(terms, "term", "left_semi"))


def grouped(occurrences: DataFrame) -> DataFrame:
    """Each term's occurrences in one text are one row, so a frequent term's rows are texts, not occurrences."""
    keys = [c for c in occurrences.columns if c != "pos"]
    return occurrences.groupBy(*keys).agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def tokenised(texts: DataFrame, keep: list[str], fields: list[Column]) -> DataFrame:
    """`keep`, length, terms (an array for each field): every text is cut into terms once. NULL texts are empty."""
    arrays = [index_terms(F.coalesce(f, F.lit(""))) for f in fields]
    return texts.select(*keep, F.array(*arrays).alias("terms")).withColumn("length", F.aggregate("terms", F.lit(0), lambda n, ts: n + F.size(ts)))


def placed(tokens: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, term, pos: one row for each occurrence; FIELD_GAP keeps fields apart, so that no phrase spans two."""
    fields = tokens.select(*keep, F.posexplode("terms").alias("field", "ts"))
    return fields.select(*keep, "field", F.posexplode("ts").alias("at", "term")).select("term", *keep, (F.col("field") * FIELD_GAP + F.col("at")).alias("pos"))


def build_index(texts: DataFrame, id_column: str, fields: list[str]) -> LexicalIndex:
    """Index several text fields of a table as one. The texts are cut into terms here and kept in the shared folder; the id is the key."""
    tokens = shared_table(tokenised(texts.withColumnRenamed(id_column, "id"), ["id"], [F.col(f) for f in fields]), "tokens")
    lengths = tokens.select("id", "length")
    return LexicalIndex(placed(tokens, ["id"]), lengths, lengths.agg(F.count("*").alias("n"), F.avg("length").alias("average")))


def phrases(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """key, phrase_id, terms: the query's first words, each as the index splits it (an underscore makes a phrase of two)."""
    word = F.posexplode(query_terms(F.col(text), MAX_TERMS)).alias("phrase_id", "word")
    out = queries.select(key, word).select(key, "phrase_id", index_terms(F.col("word")).alias("terms"))
    return out.where(F.size("terms") > 0).dropDuplicates([key, "terms"])


def occurrences(index: LexicalIndex, asked: DataFrame, key: str = "query_id") -> DataFrame:
    """key, phrase_id, id, tf: how often each phrase occurs in each text; terms of a phrase stand side by side."""
    postings = shared_table(index.of_terms(asked.select(F.explode("terms").alias("term")).distinct()), "postings")  # of all phrases, read for those of one term and of more
    single = asked.where(F.size("terms") == 1).select(key, "phrase_id", F.element_at("terms", 1).alias("term")).join(postings.select("term", "id", "tf"), "term")
    several = asked.where(F.size("terms") > 1).select(key, "phrase_id", F.size("terms").alias("k"), F.posexplode("terms").alias("n", "term"))
    starts = several.join(postings.select("term", "id", "positions"), "term").select(key, "phrase_id", "k", "id", "n", F.explode(F.transform("positions", lambda p: p - F.col("n"))).alias("start"))
    whole = starts.groupBy(key, "phrase_id", "k", "id", "start").agg(F.countDistinct("n").alias("held")).where("held = k")
    return single.select(key, "phrase_id", "id", "tf").unionByName(whole.groupBy(key, "phrase_id", "id").agg(F.count("*").cast("int").alias("tf")))


def bm25(index: LexicalIndex, queries: DataFrame, limit: int | None = 10, allowed: DataFrame | None = None, key: str = "query_id", text: str = "query") -> DataFrame:
    """key, id, score, rank: texts with any phrase of the query, best first (then by id).

    idf = ln((N - n + 0.5) / (n + 0.5)), IDF_FLOOR where that is not positive; N, n and lengths are those of
    the whole index, also where `allowed` (a table of ids) filters the result. Queries without words give no
    rows. N and the average length are scalar subqueries.
    """
    hits = occurrences(index, phrases(queries, key, text), key)
    df = hits.groupBy(key, "phrase_id").agg(F.countDistinct("id").alias("df"))
    if allowed is not None:
        hits = hits.join(allowed.select("id").distinct(), "id", "left_semi")
    n, average = (index.statistics.select(c).scalar() for c in ("n", "average"))
    scored = hits.join(df, [key, "phrase_id"]).join(index.lengths, "id").withColumn("n", n).withColumn("average", average)
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    scores = scored.groupBy(key, "id").agg(F.sum(idf * weight).alias("score"))
    order = W.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "id")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
