"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_bound, salted

#: Lines of a window.
WIDTH = 3


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """Adds __k1, __k2, an address of 128 bits by doc_id and text, and __lines; null texts have no lines."""
    return docs.withColumns({"__k1": F.xxhash64("doc_id", text), "__k2": F.xxhash64(F.lit(1), F.col(text), F.col("doc_id")), "__lines": F.split(text, "\n", -1)})


def windows(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, __k1, __k2, pos, w1, w2): each window of `width` consecutive lines by a hash of 128 bits of its lines' hashes.

    Windows of blank lines alone are formatting and left out.
    """
    one = F.transform("__lines", lambda x: F.when(F.trim(x) == "", F.lit(None)).otherwise(F.xxhash64(x)))
    two = F.transform("__lines", lambda x: F.xxhash64(F.lit(1), x))
    rows = _keyed(docs.select("doc_id", text), text).where(F.size("__lines") >= width).select("doc_id", "__k1", "__k2", one.alias("a"), two.alias("b"))
    some = lambda i: F.array(*[F.get(F.col("a"), i + k) for k in range(width)])
    each = F.transform(
        F.sequence(F.lit(0), F.size("a") - width),
        lambda i: F.struct(i.alias("pos"), F.exists(some(i), lambda x: x.isNotNull()).alias("ink"), F.xxhash64(*[F.get(F.col("a"), i + k) for k in range(width)], *[F.get(F.col("b"), i + k) for k in range(width)]).alias("w1"), F.xxhash64(F.lit(1), *[F.get(F.col("b"), i + k) for k in range(width)]).alias("w2")),
    )
    rows = rows.select("doc_id", "__k1", "__k2", F.explode(each).alias("w")).where("w.ink")
    return rows.select("doc_id", "__k1", "__k2", "w.pos", "w.w1", "w.w2")


def dedup_lines(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with `text` cut, and n_lines and n_removed (int, of lines) added.

    A window that occurs before, in document order (doc_id, then text) and line order, is a repeat; lines of repeats
    go, where overlapping repeats merge to one passage. The first occurrence stays. Lines lie between newlines;
    documents of under three lines have no window and stay as they are, as do null texts (0 lines). Rows equal in
    doc_id and text are one document and get the same text; rows without a doc_id come first. Other columns stay.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    found = windows(docs, text, width)
    place = F.struct("doc_id", "__k1", "__k2", "pos")
    first = found.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("__n")).where("first <> last")
    first = scratch.put(first.select("w1", "w2", "first", "__n"), "first")
    # a window that very many documents share is dealt to several tasks
    found, first = salted(found, first, ["w1", "w2"], ["__k1", "pos"], hot_bound(first.agg(F.sum("__n")).first()[0] or 0))
    later = found.join(first.hint("merge"), ["w1", "w2", "__salt"]).where(~place.eqNullSafe(F.col("first"))).select("__k1", "__k2", "pos")
    covered = scratch.put(later.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_set("pos")).alias("__at")), "covered")
    n = F.size("__lines")
    # the gaps between covered positions: before each repeat, and after the last
    gaps = F.transform("__at", lambda s, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("__at"), i - 1) + width).alias("a"), s.alias("b")))
    gaps = F.concat(gaps, F.array(F.struct((F.element_at("__at", -1) + width).alias("a"), n.alias("b"))))
    kept = F.flatten(F.transform(F.filter(gaps, lambda g: g["a"] < g["b"]), lambda g: F.slice("__lines", g["a"] + 1, g["b"] - g["a"])))
    # no table that grows with the input is broadcast, however small it is
    joined = _keyed(docs, text).join(covered.hint("merge"), ["__k1", "__k2"], "left")
    joined = joined.withColumn("__kept", F.when(F.col("__at").isNotNull(), kept))
    out = {
        text: F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col(text)),
        "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(n),
        "n_removed": F.when(F.col("__kept").isNotNull(), n - F.size("__kept")).otherwise(F.lit(0)),
    }
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in others], out["n_lines"].alias("n_lines"), out["n_removed"].alias("n_removed"))
