"""Which ranked hits get a seat: neighbours, documents and companies in turn."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_rows

#: Neighbours are this near, a document has so many seats.
GAP, DOC_CAP = 2, 3


def in_blocks(asked: DataFrame, key: str, each: Callable[[DataFrame], DataFrame], rows: int = 4096) -> DataFrame:
    """The union of each(block) over blocks of about `rows` rows of asked, whose size is so bounded that a block can be broadcast."""
    n = max(1, -(-asked.count() // rows))
    block = F.pmod(F.xxhash64(key), F.lit(n))
    return reduce(DataFrame.unionByName, [each(asked.where(block == k) if n > 1 else asked) for k in range(n)])


def drop_adjacent(hits: DataFrame, query: str, doc: str = "doc_id", seq: str = "seq", rank: str = "rank", gap: int = GAP) -> DataFrame:
    """Without hits that lie within `gap` of a better hit of the same document that was kept itself.

    The greedy fold goes over one document's hits of one query, so documents are independent and no list is longer
    than a query's pool.
    """
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(seq).alias("s")))),
        F.array().cast("array<struct<r:int,s:int>>"),
        lambda kept, x: F.when(F.exists(kept, lambda y: F.abs(y["s"] - x["s"]) <= gap), kept).otherwise(F.concat(kept, F.array(F.struct(x["r"].cast("int").alias("r"), x["s"].cast("int").alias("s"))))),
    )
    kept = hits.groupBy(query, doc).agg(fold.alias("k")).select(query, doc, F.explode("k.s").alias(seq))
    return hits.join(kept, [query, doc, seq], "left_semi")


def cap_documents(hits: DataFrame, query: str, doc: str = "doc_id", rank: str = "rank", cap: int = DOC_CAP, protected: Column | None = None) -> DataFrame:
    """At most `cap` hits of a document; protected hits neither count nor go."""
    safe = F.coalesce(protected, F.lit(False)) if protected is not None else F.lit(False)
    order = Window.partitionBy(query, doc, "__safe").orderBy(rank)
    numbered = hits.withColumn("__safe", safe).withColumn("__k", F.row_number().over(order))
    return numbered.where(F.col("__safe") | (F.col("__k") <= cap)).drop("__safe", "__k")


def best_of_each(hits: DataFrame, per: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first `per` rows of each group, with `place` 0 and up."""
    return first_rows(hits, by, order, per, "place")


def deal(picks: DataFrame, query: str, position: str) -> DataFrame:
    """Round robin: each company's first pick in the companies' order, then the second ones; adds `dealt`, 0 and up."""
    return picks.withColumn("dealt", F.row_number().over(Window.partitionBy(query).orderBy("place", position)) - 1)


def seat(hits: DataFrame, named: DataFrame, k: int, query: str, key: str, company: str = "company", rank: str = "rank", anchor_rank: str = "anchor_rank") -> DataFrame:
    """`seat` 0 .. k-1 for the hits of each query: anchors, then named companies in turn, then the rest by rank.

    named(query, company, position): companies a query names. Up to max(1, k // 2) anchored hits come first, by anchor
    rank. Then max(1, k // n) rounds, in each of which a company's next hit is taken, where a hit that already has a
    seat wastes the turn. A hit has the seat of its first claim. Queries that name none and have no anchor keep rank order.
    """
    counted = named.groupBy(query).agg(F.count(F.lit(1)).alias("__n"))
    anchored = hits.where(F.col(anchor_rank).isNotNull())
    by_anchor = Window.partitionBy(query).orderBy(anchor_rank, rank)
    one = anchored.withColumn("__o", F.row_number().over(by_anchor) - 1).where(F.col("__o") < max(1, k // 2))
    one = one.select(query, key, F.struct(F.lit(0).alias("phase"), F.col("__o").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("claim"))
    own = hits.join(named, [query, company]).join(counted, query)
    own = own.withColumn("__i", F.row_number().over(Window.partitionBy(query, company).orderBy(rank)) - 1)
    two = own.where(F.col("__i") < F.greatest(F.lit(1), F.floor(F.lit(k) / F.col("__n"))))
    two = two.select(query, key, F.struct(F.lit(1).alias("phase"), F.col("__i").cast("long").alias("a"), F.col("position").cast("long").alias("b")).alias("claim"))
    three = hits.select(query, key, F.struct(F.lit(2).alias("phase"), F.col(rank).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("claim"))
    claims = one.unionByName(two).unionByName(three).groupBy(query, key).agg(F.min("claim").alias("claim"))
    seats = first_rows(claims, [query], ["claim", key], k, "seat")
    return hits.join(seats.select(query, key, "seat"), [query, key])
