"""Reciprocal-rank fusion of channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The rank constant, the weight of a rewritten query, results of a channel.
RRF, REWRITE, POOL = 60, 0.6, 100


def votes(ranked: DataFrame, query: str, key: str, weight: float | str = 1.0) -> DataFrame:
    """(query, key, vote) of a ranked list, whose ranks begin at 0."""
    w = F.col(weight) if isinstance(weight, str) else F.lit(float(weight))
    return ranked.select(query, key, (w / (RRF + F.col("rank"))).alias("vote"))


def fuse(lists: list[DataFrame], query: str, key: str, how: str = "sum") -> DataFrame:
    """(query, key, score, rank): all votes of a key together (or its best one), rounded to nine places."""
    total = F.sum("vote") if how == "sum" else F.max("vote")
    fused = reduce(DataFrame.unionByName, lists).groupBy(query, key).agg(F.round(total, 9).alias("score"))
    best = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return fused.withColumn("rank", F.row_number().over(best) - 1)
