"""Where built tables live: checked chunk stores, versions that are never changed in place, work that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Mismatch(ValueError):
    """Tables that should fit each other do not."""


def check_chunks(chunks: DataFrame, vectors: DataFrame | None = None, key: str = "chunk_id") -> None:
    """Raises if a key is missing or not unique, a text is blank, or vectors have other keys than chunks."""
    row = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank")).first()
    if row["n"] != row["keys"]:
        raise Mismatch(f"{row['n']} chunks have {row['keys']} keys")
    if row["blank"]:
        raise Mismatch(f"{row['blank']} chunks have no text")
    if vectors is not None:
        lost, extra = (a.join(b, key, "left_anti").count() for a, b in ((chunks.select(key), vectors.select(key)), (vectors.select(key), chunks.select(key))))
        if lost or extra:
            raise Mismatch(f"{lost} chunks have no vector, {extra} vectors no chunk")


def write_chunks(chunks: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """Writes checked chunks by source, so that a filter on the source reads its folder alone."""
    check_chunks(chunks, vectors)
    chunks.write.partitionBy("source").parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions in a folder, in any store that Spark reads."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = (s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v="))
    return sorted(int(p.getName()[2:]) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def write_version(df: DataFrame, path: str) -> int:
    """Writes a new version beside the others; readers of the last one are not disturbed."""
    no = max(versions(df.sparkSession, path), default=-1) + 1
    df.write.mode("overwrite").parquet(f"{path}/v={no}")  # what a run that broke off left under this number goes
    return no


def read_version(spark: SparkSession, path: str, no: int | None = None) -> DataFrame:
    """A version, by default the last complete one."""
    known = versions(spark, path)
    if not known or no is not None and no not in known:
        raise FileNotFoundError(f"{path} has versions {known}")
    return spark.read.parquet(f"{path}/v={known[-1] if no is None else no}")


def left_to_do(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return expected.join(done.select(key).distinct(), key, "left_anti")


def fingerprint(texts: DataFrame, text: str = "text") -> str:
    """One hash of a set of distinct texts in any order: sums of hashes, so no task sees them all."""
    parts = texts.select(F.sha1(text).alias("h")).distinct().select(*[F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)").alias(f"p{k}") for k in range(5)])
    row = parts.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0)).alias(f"s{k}") for k in range(5)]).first()
    return "-".join(f"{int(v):x}" for v in row)


def check_fingerprint(texts: DataFrame, expected: str, text: str = "text") -> None:
    """Raises if the texts are not those of a plan that was made before."""
    if (own := fingerprint(texts, text)) != expected:
        raise Mismatch(f"the texts have the fingerprint {own}, the plan {expected}")
