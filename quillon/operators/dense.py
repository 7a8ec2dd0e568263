"""Cosine search over keyed vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import first_rows

#: Queries that go to the executors at a time, and vectors that are compared with them at a time.
QUERIES, ROWS = 1024, 8192


def dot(a, b):
    """The inner product of two array columns, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a):
    return F.sqrt(dot(a, a))


def top(queries: DataFrame, vectors: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", vector: str = "embedding", within: list[str] | None = None) -> DataFrame:
    """(query, key, sim, rank): the k vectors of highest cosine for each query, sim rounded to six places, ties to the smaller key.

    Each block of rows is compared with each block of queries by a matrix product and sends its k best on, so the
    shuffle has k rows a query and block. within: columns that both sides have and that must agree.
    """
    within = within or []
    spark, names = vectors.sparkSession, [*within, key]
    asked = queries.select(query, *within, F.col(vector).alias("__v")).where(F.col("__v").isNotNull())
    n = max(1, -(-asked.count() // QUERIES))
    blocks = asked.withColumn("__block", F.pmod(F.xxhash64(query), F.lit(n)))
    out = None
    for b in range(n):
        rows = blocks.where(F.col("__block") == b).drop("__block").collect()  # about QUERIES rows
        if not rows:
            continue
        found = _pass(spark, rows, vectors, k, query, key, vector, within)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.select(query).join(vectors.select(*names), F.lit(False)).select(query, key, F.lit(0.0).alias("sim"))
    return first_rows(out, [query], [F.desc("sim"), key], k)


def _pass(spark, rows, vectors, k, query, key, vector, within) -> DataFrame:
    shared = spark.sparkContext.broadcast(([r[query] for r in rows], [tuple(r[c] for c in within) for r in rows], np.array([r["__v"] for r in rows], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, q = shared.value
        place = {g: k for k, g in enumerate(dict.fromkeys(groups))}
        asked = np.array([place[g] for g in groups])
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                x = some.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
                sims = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
                keys = some.column(key).to_numpy(zero_copy_only=False)
                if within:
                    own = zip(*(some.column(c).to_pylist() for c in within))
                    sims[asked[:, None] != np.array([place.get(o, -1) for o in own])] = -np.inf
                order = np.lexsort((np.broadcast_to(keys, sims.shape), -sims))[:, :k]
                at, col = np.repeat(np.arange(len(ids)), order.shape[1]), order.ravel()
                real = np.isfinite(sims[at, col])
                at, col = at[real], col[real]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array(keys[col], pa.int64()), pa.array(sims[at, col])], names=[query, key, "sim"])

    usable = vectors.where(F.col(vector).isNotNull()).select(*within, key, vector)
    return usable.mapInArrow(run, f"{query} long, {key} long, sim double")


def parity(a: DataFrame, b: DataFrame, key: str, vector: str = "embedding", least: float = 0.9999) -> DataFrame:
    """One row of the cosines between two versions of the same vectors: n, min_cos, mean_cos, below."""
    both = a.select(key, F.col(vector).alias("__a")).join(b.select(key, F.col(vector).alias("__b")), key)
    c = F.round(dot(F.col("__a"), F.col("__b")) / (norm(F.col("__a")) * norm(F.col("__b"))), 6)
    return both.select(c.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("min_cos"), F.round(F.avg("c"), 6).alias("mean_cos"), F.count_if(F.col("c") < least).alias("below"))
