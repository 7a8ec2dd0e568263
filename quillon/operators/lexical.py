"""BM25 over keyed tables: postings (id, term, tf), lengths (id, doclen), vocabulary (term, df)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import first_rows
from .scratch import Store

K1, B = 1.5, 0.75


class Index(NamedTuple):
    """postings (key, term, tf, w), where w is what a posting adds to the score of a query with the term; lengths, vocabulary, stats."""

    postings: DataFrame
    lengths: DataFrame
    vocabulary: DataFrame
    stats: DataFrame

    def write(self, path: str) -> None:
        """Postings are sorted by term within files, so that a query's terms skip row groups."""
        self.postings.repartition("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
        for name in ("lengths", "vocabulary", "stats"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> "Index":
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls._fields))


def terms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf) of all tokens but stop words; tokens become rows before their forms are taken, as plain columns."""
    raw = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(T.TOKEN), F.lit(0))).alias("raw")).select(key, F.lower("raw").alias("raw"))
    found = raw.select(key, F.explode(T.token_forms(F.col("raw"))).alias("term")).where(~F.col("term").isin(T.STOP))
    return found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def build(docs: DataFrame, key: str, text: str = "text", store: Store | None = None) -> Index:
    """Lengths count tokens before the vocabulary is cut to terms of two characters and two documents or more.

    Weights are taken once, here, so that a query reads the postings of its terms and nothing else. With a store, texts
    are cut to tokens once and counts are written; their joins are then between written tables, where the postings of a
    very common term can be dealt to several tasks.
    """
    put = store.put if store else lambda df, name: df
    found = put(terms(docs, key, text), "terms")
    lengths = docs.select(key).join(found.groupBy(key).agg(F.sum("tf").alias("doclen")), key, "left").select(key, F.coalesce("doclen", F.lit(0)).alias("doclen"))
    lengths = put(lengths, "lengths")
    vocabulary = put(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= 2) & (F.length("term") > 1)), "vocabulary")
    stats = lengths.agg(F.count(F.lit(1)).alias("n_doc"), F.avg("doclen").alias("avgdl"))
    idf = F.log1p((F.col("n_doc") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doclen") / F.col("avgdl")))
    weighed = found.join(vocabulary, "term").join(lengths, key).crossJoin(F.broadcast(stats))  # stats: one row
    return Index(weighed.select(key, "term", "tf", w.alias("w")), lengths, vocabulary, stats)


def query_terms(queries: DataFrame, query: str, text: str = "text") -> DataFrame:
    """(query, term, at): each distinct term, and where it first comes."""
    rows = queries.select(query, F.posexplode(T.tokens(F.col(text))).alias("at", "term"))
    return rows.groupBy(query, "term").agg(F.min("at").alias("at"))


def search(index: Index, queries: DataFrame, key: str, query: str, pool: int = 100, text: str = "text") -> DataFrame:
    """(query, key, score, matched, rank): the `pool` best documents of each query; rank is 0 and up.

    Scores are rounded to six places before ranking, ties go to the smaller key; matched are the terms in query order.
    The query's terms are few; they meet the postings in a hash join by term, and sums are pre-aggregated.
    """
    asked = query_terms(queries, query, text)
    hits = index.postings.join(asked, "term").groupBy(query, key)
    scored = hits.agg(F.round(F.sum("w"), 6).alias("score"), F.array_sort(F.collect_list(F.struct("at", "term"))).alias("m"))
    scored = scored.select(query, key, "score", F.col("m.term").alias("matched"))
    return first_rows(scored, [query], [F.desc("score"), key], pool)
