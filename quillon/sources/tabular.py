"""Listings and manifests: nested JSON to rows, last records, first ones of each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each (source, url) of a JSON-lines manifest; bad lines are skipped."""
    rows = spark.read.schema(schemas.MANIFEST).option("mode", "DROPMALFORMED").json(path)
    return last_records(rows.where("source is not null and url is not null"), ["source", "url"], "fetched_at")


def last_records(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(at))
    return rows.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def zipped(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays to one row for each position."""
    return rows.select(*keys, F.explode(F.arrays_zip(*arrays)).alias("r")).select(*keys, "r.*")


def first_of_each(rows: DataFrame, kind: str, kinds: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each kind."""
    best = Window.partitionBy(kind).orderBy(*order)
    return rows.where(F.col(kind).isin(kinds)).withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= n).drop("__k")


def slots(rows: DataFrame, keys: list[str], names: list[str], n: int, as_names: list[str]) -> DataFrame:
    """Numbered columns name1 .. namen to rows (keys, slot, names); slots whose first column is empty are dropped."""
    parts = ", ".join(f"{k}, " + ", ".join(f"`{name}{k}`" for name in names) for k in range(1, n + 1))
    out = rows.selectExpr(*keys, f"stack({n}, {parts}) as (slot, {', '.join(as_names)})")
    return out.where(F.col(as_names[0]).isNotNull() & (F.col(as_names[0]).cast("string") != ""))


def names_from_urls(rows: DataFrame, url: str, name: str) -> DataFrame:
    """Fills empty names with the last part of the path."""
    return rows.withColumn(name, F.coalesce(F.when(F.col(name) != "", F.col(name)), F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1)))


def since(rows: DataFrame, name: str, least: int) -> DataFrame:
    """Rows whose name has no year, or one from `least` on; adds `year`, 0 where there is none."""
    year = F.coalesce(F.regexp_extract(name, "(20[0-9]{2})", 1).try_cast("int"), F.lit(0))
    return rows.withColumn("year", year).where((F.col("year") == 0) | (F.col("year") >= least))


def odd_dates(rules: DataFrame) -> DataFrame:
    """Adds `note` where a rule takes effect before it is published."""
    early = F.try_to_timestamp("effective_on").cast("date") < F.try_to_timestamp("publication_date").cast("date")
    return rules.withColumn("note", F.when(early, "effective before publication"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of landed files, whatever store they are in."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
