"""Reports over the corpus: totals, sizes, coverage, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(docs: DataFrame, by: str, sums: dict[str, Column]) -> DataFrame:
    """(by, n, sums): a row for each value and one, with `all` in its place, for the whole."""
    out = docs.rollup(by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()], F.grouping(by).alias("__g"))
    return out.withColumn(by, F.when(F.col("__g") == 1, "all").otherwise(F.col(by))).drop("__g")


def size_percentiles(rows: DataFrame, size: str, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """(share, size): the size at place min(n - 1, floor(n * share)) of all sizes in order.

    Sizes are counted first: places are running sums over distinct sizes, a far smaller table than the rows.
    """
    counts = rows.groupBy(size).agg(F.count(F.lit(1)).alias("c"))
    n = counts.agg(F.sum("c").alias("n"))
    upto = Window.orderBy(size).rowsBetween(Window.unboundedPreceding, 0)  # over distinct sizes
    steps = counts.withColumn("hi", F.sum("c").over(upto)).withColumn("lo", F.col("hi") - F.col("c"))
    places = n.select(F.explode(F.array(*[F.struct(F.lit(q).alias("share"), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q))).alias("at")) for q in shares])).alias("p")).select("p.*")
    return steps.join(F.broadcast(places), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("share", F.col(size).alias("size"))


def histogram(rows: DataFrame, reasons: str, most: int = 8) -> DataFrame:
    """(reason, n): the commonest first words of the entries of an array column."""
    word = F.get(F.split(F.col("r"), " "), 0)
    return rows.select(F.explode(reasons).alias("r")).groupBy(word.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def roster(files: DataFrame, company: str, source: str, date: str, content: Column) -> DataFrame:
    """(company, n_files, n_contents, n_sources, sources, first, last) of all files."""
    rows = files.withColumn("__h", content)
    out = rows.groupBy(company).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_distinct("__h").alias("n_contents"), F.count_distinct(source).alias("n_sources"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"), F.min(date).alias("first"), F.max(date).alias("last")
    )
    return out


def commonest(rows: DataFrame, key: str, found: Column, least: int = 3) -> DataFrame:
    """(key, label, n): the entry of an array that a row repeats most, of those that occur `least` times or more."""
    counts = rows.select(key, F.explode(found).alias("label")).groupBy(key, "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    best = counts.groupBy(key).agg(F.max(F.struct("n", "label")).alias("b"))
    return best.select(key, "b.label", "b.n")


def spread_sample(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """n rows of each group, evenly spaced in its order: those at places floor(k * size / n)."""
    w = Window.partitionBy(by)
    numbered = rows.withColumn("__at", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    step = lambda at: F.floor((at * n + F.col("__n") - 1) / F.col("__n"))
    return numbered.where((F.col("__n") <= n) | (F.floor(step(F.col("__at")) * F.col("__n") / n) == F.col("__at")) & (step(F.col("__at")) < n)).drop("__at", "__n")


def header_changes(rows: DataFrame, old: str, new: str, credible: str) -> DataFrame:
    """(class, n, share) of tables by the header row that an old and a new rule pick (null: none) and whether the old one could be a header.

    A: the same row; D: it was one and is lost; E: it was one and is another now; B: it was none and one is found; C: none either way.
    """
    kind = F.when(F.col(credible), F.when(F.col(old) == F.col(new), "A").when(F.col(new).isNull(), "D").otherwise("E")).otherwise(F.when(F.col(new).isNotNull(), "B").otherwise("C"))
    counts = rows.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("__all")))).select("class", "n", F.round(F.col("n") / F.col("__all"), 6).alias("share"))  # one row
