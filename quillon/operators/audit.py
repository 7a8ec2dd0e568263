"""Corpus audits: content hashes, cross-source dedup, reconciliation, reuse, cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed value: which source's copy of a file stays.
PRIORITY = ("cninfo", "szse", "sec", "samsung", "skhynix", "fedreg", "ecfr", "govinfo")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    best = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k")


def priority(source: Column, order: tuple[str, ...] = PRIORITY) -> Column:
    """The place of a source, unknown ones after all others."""
    place = F.array_position(F.array(*map(F.lit, order)), source)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def dedup_plan(files: DataFrame, key: str = "sha256", order: tuple[str, ...] = PRIORITY) -> DataFrame:
    """(key, winner, n_sources): for each content in two sources or more, the source that stays."""
    rows = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(priority(F.col("source"), order).alias("p"), F.col("source").alias("s"))).alias("w"), F.count_distinct("source").alias("n_sources"))
    return rows.where("n_sources >= 2").select(key, F.col("w.s").alias("winner"), "n_sources")


def dedup_across_sources(rows: DataFrame, files: DataFrame, key: str = "sha256", doc: str = "doc_id", order: tuple[str, ...] = PRIORITY) -> DataFrame:
    """rows(doc, source, ...) without those of losing copies; equal files of one source, and unknown documents, stay."""
    known = latest(files.select(doc, key, "source"), [doc], [key, "source"])
    lost = known.join(dedup_plan(known, key, order), key).where(F.col("source") != F.col("winner")).select(doc)
    return rows.join(lost, doc, "left_anti")


def shared_ratio(blocks: DataFrame, left: str, right: str, by: str = "company") -> DataFrame:
    """(by, n_left, n_shared, ratio): distinct texts of one source that another source also has."""
    hashed = blocks.select(by, "source", F.sha1("text").alias("h")).distinct()
    a, b = (hashed.where(F.col("source") == s).select(by, "h") for s in (left, right))
    both = a.join(b.withColumn("hit", F.lit(1)), [by, "h"], "left")
    out = both.groupBy(by).agg(F.count(F.lit(1)).alias("n_left"), F.count("hit").alias("n_shared"))
    return out.withColumn("ratio", F.round(F.col("n_shared") / F.col("n_left"), 6))


def compare_manifests(expected: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """(key, state): missing, extra, size, hash or ok, by full outer join of (key, bytes, sha256)."""
    e, a = expected.select(key, F.col("bytes").alias("eb"), F.col("sha256").alias("es")), actual.select(key, F.col("bytes").alias("ab"), F.col("sha256").alias("ah"))
    both = e.withColumn("e", F.lit(True)).join(a.withColumn("a", F.lit(True)), key, "full")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(~F.col("eb").eqNullSafe(F.col("ab")), "size").when(~F.col("es").eqNullSafe(F.col("ah")), "hash").otherwise("ok")
    return both.select(key, state.alias("state"))


def reconcile(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(left, right, n_left, n_only_left): for each ordered pair of tables, how many keys only the first has."""
    out = None
    for a, left in tables.items():
        for b, right in tables.items():
            if a == b:
                continue
            one = left.select(key).distinct().join(right.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
            row = one.agg(F.count(F.lit(1)).alias("n_left"), F.count_if(F.col("hit").isNull()).alias("n_only_left")).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "n_left", "n_only_left")
            out = row if out is None else out.unionByName(row)
    return out


def reuse_plan(new: DataFrame, old: DataFrame, key: str, old_key: str, text: str = "text") -> DataFrame:
    """(key, h, reuse): for each new row, the first old row of the same text, or null where it is to be computed."""
    known = old.select(F.sha1(text).alias("h"), F.col(old_key).alias("reuse")).groupBy("h").agg(F.min("reuse").alias("reuse"))
    return new.select(key, F.sha1(text).alias("h")).join(known, "h", "left").select(key, "h", "reuse")


def cross_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files of one channel beside those of another, (company, kind, year, name, sha256, pages) each.

    A file is compared with one of the same version tag if there is one, else with any of the same report; columns
    name, other, same_bytes, same_pages (null without a partner).
    """
    left = a.select("company", "kind", "year", "name", F.col("sha256").alias("sa"), F.col("pages").alias("pa"), T.version_tag(F.col("name")).alias("va"))
    right = b.select("company", "kind", "year", F.col("name").alias("other"), F.col("sha256").alias("sb"), F.col("pages").alias("pb"), T.version_tag(F.col("name")).alias("vb"))
    best = Window.partitionBy("company", "kind", "year", "name").orderBy(F.desc(F.coalesce(F.col("va") == F.col("vb"), F.lit(False))), "other")
    rows = left.join(right, ["company", "kind", "year"], "left").withColumn("__k", F.row_number().over(best)).where("__k = 1")
    return rows.select("company", "kind", "year", "name", "other", (F.col("sa") == F.col("sb")).alias("same_bytes"), (F.col("pa") == F.col("pb")).alias("same_pages"))


def completeness(expected: DataFrame, pages: DataFrame, trailers: DataFrame) -> DataFrame:
    """(doc_id, state): missing (no pages), broken (no trailer), mismatch (trailer counts other pages) or ok."""
    got = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = expected.select("doc_id").join(got, "doc_id", "left").join(trailers.select("doc_id", F.col("pages").alias("p")), "doc_id", "left")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("p").isNull(), "broken").when(F.col("n") != F.col("p"), "mismatch").otherwise("ok")
    return rows.select("doc_id", state.alias("state"))
