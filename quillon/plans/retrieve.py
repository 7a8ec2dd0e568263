"""The whole search: channels, fusion, neighbours, document caps, seats."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense, fusion, lexical, select
from ..operators.scratch import Store


class Settings(NamedTuple):
    pool: int = fusion.POOL
    gap: int = select.GAP
    cap: int = select.DOC_CAP
    k: int = 8
    most: int = 50

    def clamped(self) -> "Settings":
        """k between 1 and `most`."""
        return self._replace(k=max(1, min(self.most, self.k)))


def anchor_channel(chunks: DataFrame, anchors: DataFrame, bm25: DataFrame, query: str, key: str, pool: int = fusion.POOL, numbered: bool = True, scope: DataFrame | None = None) -> DataFrame:
    """(query, key, anchor_hits, rank): chunks with rows whose label ends with an anchor of anchors(query, anchor).

    Lines with a separator are found first, and labels taken once a chunk; ranked by hits, then by BM25 rank (those
    without one as `pool`), then key. numbered: rows need a digit. scope(query, company): where a question names companies,
    only chunks whose company has one of these names count.
    """
    rows = chunks.where(F.contains("text", F.lit(T.ROW_SEPARATOR))).select(key, F.explode(F.split("text", "\n")).alias("line"))
    rows = rows.where(F.contains("line", F.lit(T.ROW_SEPARATOR)) & (F.col("line").rlike("[0-9]") if numbered else F.lit(True))).select(key, T.row_label(F.col("line")).alias("label"))
    # an anchor ends a label if it is one of the label's endings: a join by equality, for any number of anchors
    lengths = anchors.agg(F.collect_set(F.length("anchor")).alias("__l"))  # one row
    ends = F.transform(F.filter("__l", lambda n: n <= F.length("label")), lambda n: F.right(F.col("label"), n))
    rows = rows.crossJoin(F.broadcast(lengths)).select(key, F.explode(ends).alias("anchor"))
    hits = rows.join(anchors, "anchor").groupBy(query, key).agg(F.count(F.lit(1)).alias("anchor_hits"))
    if scope is not None:
        own = hits.join(chunks.select(key, "company"), key).join(scope.select(query, F.col("company").alias("__c")), query, "left")
        hits = own.where(F.col("__c").isNull() | F.contains(F.coalesce("company", F.lit("")), F.col("__c"))).select(query, key, "anchor_hits").distinct()
    hits = hits.join(bm25.select(query, key, F.col("rank").alias("__b")), [query, key], "left")
    best = Window.partitionBy(query).orderBy(F.desc("anchor_hits"), F.coalesce("__b", F.lit(pool)), key)
    return hits.select(query, key, "anchor_hits", (F.row_number().over(best) - 1).alias("rank"))


def company_channel(sims: DataFrame, named: DataFrame, k: int, query: str, key: str, company: str = "company") -> DataFrame:
    """(query, key, company, rank): of each named company the max(1, k // n) best by cosine, dealt in turn.

    sims(query, key, company, sim); named(query, company, position).
    """
    counted = named.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(query)))
    own = sims.join(counted, [query, company])
    place = F.row_number().over(Window.partitionBy(query, company).orderBy(F.desc("sim"), key)) - 1
    picks = own.withColumn("place", place).where(F.col("place") < F.greatest(F.lit(1), F.floor(F.lit(k) / F.col("__n"))))
    return select.deal(picks, query, "position").select(query, key, company, F.col("dealt").alias("rank"))


def named_companies(questions: DataFrame, companies: DataFrame, query: str, text: str = "text") -> DataFrame:
    """(query, company, alias, position): companies(company) that a question names, in the order of their names."""
    names = companies.select("company").distinct().select("company", F.posexplode(T.aliases(F.col("company"))).alias("k", "alias")).where("alias <> ''")
    lengths = names.agg(F.collect_set(F.length("alias")).alias("__l"))  # one row
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    parts = F.array_distinct(F.flatten(F.transform("__l", lambda n: F.transform(starts, lambda i: F.substr(F.col(text), i, n)))))
    asked = questions.crossJoin(F.broadcast(lengths)).select(query, F.explode(parts).alias("alias"))
    found = asked.join(names, "alias").groupBy(query, "company").agg(F.min(F.struct("k", "alias")).alias("a"))
    order = Window.partitionBy(query).orderBy("company")
    return found.select(query, "company", "a.alias", (F.row_number().over(order) - 1).alias("position"))


def rewrite_votes(index: lexical.Index, vectors: DataFrame, rewrites: DataFrame, query: str, key: str, pool: int) -> list[DataFrame]:
    """Votes at the weight REWRITE of the BM25 list, and with an `embedding` of the cosine list, of each row of rewrites(query, pos, text[, embedding])."""
    asked = rewrites.withColumn("__q", F.xxhash64(query, "pos"))
    found = [lexical.search(index, asked, key, "__q", pool)]
    if "embedding" in rewrites.columns:
        found.append(dense.top(asked, vectors, pool, "__q", key))
    whose = asked.select("__q", query).distinct()
    return [fusion.votes(ranked.join(whose, "__q"), query, key, fusion.REWRITE) for ranked in found]


def company_picks(chunks: DataFrame, vectors: DataFrame, asked: DataFrame, named: DataFrame, k: int, query: str, key: str) -> DataFrame:
    """The company channel of asked(query, embedding): cosines are taken within each named company alone."""
    pairs = asked.join(named, query).withColumn("__q", F.xxhash64(query, "company"))
    own = vectors.join(chunks.select(key, "company"), key)
    sims = dense.top(pairs.select("__q", "company", "embedding"), own, k, "__q", key, within=["company"])
    sims = sims.join(pairs.select("__q", query, "company"), "__q").select(query, key, "company", "sim")
    return company_channel(sims, named, k, query, key)


def search(
    chunks: DataFrame, index: lexical.Index, vectors: DataFrame, questions: DataFrame, asked: DataFrame, named: DataFrame, query: str = "query_id", key: str = "row", doc: str = "doc_id", seq: str = "seq", settings: Settings = Settings(), anchors: DataFrame | None = None, numbered: bool = True, store: Store | None = None, rewrites: DataFrame | None = None
) -> DataFrame:
    """Seated hits of each question: the chunk's columns, score, channels, ranks of channels (null: no vote), seat.

    questions(query, text), asked(query, embedding), named(query, company, position), vectors(key, embedding). Channels
    are BM25, cosine, anchors(query, anchor), the named companies, and BM25 and cosine of rewrites(query, pos, text[,
    embedding]). With a store, the channels' pools are written once. Neighbours go first, then the document cap, from which anchored hits are safe, then seats are dealt.
    """
    settings = settings.clamped()
    keep = store.put if store else lambda df, name: df
    bm25 = keep(lexical.search(index, questions, key, query, settings.pool), "bm25")
    near = keep(dense.top(asked, vectors, settings.pool, query, key), "near")
    lists = [fusion.votes(bm25, query, key), fusion.votes(near, query, key)]
    if anchors is not None:
        anchored = keep(anchor_channel(chunks, anchors, bm25, query, key, settings.pool, numbered), "anchored")
        lists.append(fusion.votes(anchored, query, key))
        ranks = anchored.select(query, key, F.col("rank").alias("anchor_rank"), "anchor_hits")
    own = keep(company_picks(chunks, vectors, asked, named, settings.k, query, key), "companies")
    lists.append(fusion.votes(own, query, key))
    if rewrites is not None:
        lists += rewrite_votes(index, vectors, rewrites, query, key, settings.pool)
    fused = fusion.fuse(lists, query, key)
    hits = fused.join(bm25.select(query, key, F.col("rank").alias("bm25_rank"), "matched"), [query, key], "left")
    hits = hits.join(near.select(query, key, F.col("rank").alias("dense_rank"), F.col("sim").alias("dense_sim")), [query, key], "left")
    hits = hits.join(ranks, [query, key], "left") if anchors is not None else hits.withColumns({"anchor_rank": F.lit(None).cast("int"), "anchor_hits": F.lit(None).cast("long")})
    hits = hits.join(own.select(query, key, F.col("rank").alias("company_rank")), [query, key], "left")
    hits = hits.join(chunks, key)
    hits = keep(hits, "hits")
    hits = select.drop_adjacent(hits, query, doc, seq, "rank", settings.gap)
    hits = select.cap_documents(hits, query, doc, "rank", settings.cap, F.col("anchor_rank").isNotNull())
    seated = select.seat(hits, named, settings.k, query, key)
    return seated.withColumn("channels", T.channels(F.col("bm25_rank"), F.col("dense_rank"), F.col("anchor_rank"), F.col("company_rank")))
