"""The registered queries of the engine's own operators, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, chunking, dense, fusion, judge, lexical, profile, select
from ..operators.scratch import Store, folder
from ..sources import html, plain, tabular
from ..streaming import ingest
from . import retrieve
from . import sqltext as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixed values of the queries: a stand-in for companies a question names, anchors that questions quote, source order.
NAMED, ANCHORS, SOURCES = ("de", "fr"), ("ed", "the"), tuple(f"src{k}" for k in range(20))


def query(sql: str | None = None):
    """Registers a function (spark, tables) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- lexical index


@query(f"with {S.tokens('tok', 'documents', 'doc_id')} select doc_id, t as term, count(*) as tf from tok group by all")
def term_freq(spark, t):
    """Terms of each document with their counts."""
    return lexical.terms(t("documents"), "doc_id")


@query(f"with {S.tokens('tok', 'documents', 'doc_id')} select t as term, count(distinct doc_id) as df from tok group by t having count(distinct doc_id) >= 2 and length(t) > 1")
def doc_freq_vocab(spark, t):
    """The vocabulary with document frequencies."""
    return lexical.build(t("documents"), "doc_id").vocabulary


@query(f"with {S.tokens('tok', 'documents', 'doc_id')}, l as (select d.doc_id, count(tok.doc_id) as n from documents d left join tok on tok.doc_id = d.doc_id group by all) select count(*) as n_doc, round(avg(n), 6) as avgdl, max(n) as longest from l")
def doclen_avgdl(spark, t):
    """Index statistics: documents, mean and largest length."""
    return lexical.build(t("documents"), "doc_id").lengths.agg(F.count(F.lit(1)).alias("n_doc"), F.round(F.avg("doclen"), 6).alias("avgdl"), F.max("doclen").alias("longest"))


@query(f"with {S.tokens('tok', 'benchmark', 'item_id')} select item_id, t as term, min(ord) // 1000000 as first_at, count(*) as tf from tok group by all")
def tokenize_terms(spark, t):
    """Terms of questions, where the raw token that has them first comes, and how often they occur."""
    raw = t("benchmark").select("item_id", F.posexplode(T.raw_tokens(F.col("text"))).alias("at", "raw")).select("item_id", "at", F.explode(T.token_forms(F.col("raw"))).alias("term"))
    return raw.where(~F.col("term").isin(T.STOP)).groupBy("item_id", "term").agg(F.min("at").cast("long").alias("first_at"), F.count(F.lit(1)).alias("tf"))


_indexes: dict[tuple, lexical.Index] = {}


def _index(t) -> lexical.Index:
    """The index of the documents, built and written by the first query that asks for it; the others read it.

    It goes by the files and when they were written, so another table, or another state of it, has its own.
    """
    docs = t("documents")
    spark = docs.sparkSession
    files = docs.select(F.col("_metadata.file_path"), F.col("_metadata.file_size"), F.col("_metadata.file_modification_time")).distinct().collect()  # a row a file
    state = (spark.sparkContext.applicationId, *sorted(map(str, files)))
    if state not in _indexes:
        store = Store(spark, "index")
        lexical.build(docs, "doc_id", store=store).write(f"{store.path}/whole")
        _indexes[state] = lexical.Index.read(spark, f"{store.path}/whole")
    return _indexes[state]


def _bm25(t) -> DataFrame:
    found = lexical.search(_index(t), t("benchmark"), "doc_id", "item_id")
    return Store(found.sparkSession, "bm25").put(found, "hits")


_BM25 = S.bm25("bm", "documents", "doc_id", "benchmark", "item_id")


@query(f"with {_BM25} select item_id, rank, doc_id, score from bm where rank < 10")
def bm25_top10(spark, t):
    """The ten best documents of each benchmark item by BM25."""
    return _bm25(t).where("rank < 10").select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@query(f"with {_BM25} select item_id, rank, doc_id, array_to_string(matched, ' ') as matched from bm where rank < 10")
def bm25_matched_terms(spark, t):
    """Which terms matched, in query order."""
    return _bm25(t).where("rank < 10").select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.array_join("matched", " ").alias("matched"))


# ---------------------------------------------------------------- dense search

_VECTORS = "v as (select vec_id, embedding::double[] as v, label from embeddings), a as (select vec_id as query_id, v as q, label as l from v where vec_id % 100 = 0)"


def _asked(t) -> DataFrame:
    """Queries: the vectors whose id 100 divides."""
    return t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


@query(f"with {_VECTORS}, {S.dense('ds', 'a', 'query_id', 'v', 'vec_id', 10)} select query_id, vec_id, sim, rank from ds")
def dense_top10(spark, t):
    """The ten vectors of highest cosine for each query vector, among all vectors."""
    return dense.top(_asked(t), t("embeddings"), 10).select("query_id", "vec_id", "sim", F.col("rank").cast("long").alias("rank"))


@query(f"with {_VECTORS}, {S.dense('ds', 'a', 'query_id', 'v', 'vec_id', 5, 'a.l = b.label')} select query_id, vec_id, sim, rank from ds")
def dense_subset_rank(spark, t):
    """The five nearest within the query's own label."""
    return dense.top(_asked(t), t("embeddings"), 5, within=["label"]).select("query_id", "vec_id", "sim", F.col("rank").cast("long").alias("rank"))


@query("select count(*) as n, round(min(sqrt(list_dot_product(v, v))), 6) as min_norm, round(max(sqrt(list_dot_product(v, v))), 6) as max_norm, count(*) filter (len(v) <> 64) as odd_dims, count(*) filter (not list_bool_and([isfinite(x) for x in v])) as not_finite from (select embedding::double[] as v from embeddings)")
def vector_checks(spark, t):
    """Norms, dimensions and non-finite components of all vectors."""
    v = t("embeddings").select(dense.norm(F.col("embedding")).alias("n"), F.size("embedding").alias("d"), F.forall("embedding", lambda x: F.abs(x) < float("inf")).alias("f"))
    return v.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("n"), 6).alias("min_norm"), F.round(F.max("n"), 6).alias("max_norm"), F.count_if(F.col("d") != 64).alias("odd_dims"), F.count_if(~F.col("f")).alias("not_finite"))


@query("with a as (select vec_id, embedding::double[] as v from embeddings), c as (select round(list_dot_product(v, v) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(v, v))), 6) as c from a) select count(*) as n, min(c) as min_cos, round(avg(c), 6) as mean_cos, count(*) filter (c < 0.9999) as below from c")
def vector_parity(spark, t):
    """Cosines between a set of vectors and the same set at twice the length."""
    return dense.parity(t("embeddings"), t("embeddings").withColumn("embedding", F.transform("embedding", lambda x: x * 2)), "vec_id")


# ---------------------------------------------------------------- fusion

_DOCVEC = "v as (select vec_id as doc_id, embedding::double[] as v from embeddings where vec_id in (select doc_id from documents)), a as (select item_id, embedding::double[] as q from benchmark join embeddings on vec_id = item_id)"
_CHANNELS = f"{_BM25}, {_DOCVEC}, {S.dense('ds', 'a', 'item_id', 'v', 'doc_id', 100)}"
_FUSED = "f as (select *, row_number() over (partition by item_id order by score desc, doc_id) - 1 as rank from (select item_id, doc_id, round({how}(vote), 9) as score from ({votes}) group by all))"
_TWO = "select item_id, doc_id, 1.0::double / (60 + rank) as vote from bm union all select item_id, doc_id, 1.0::double / (60 + rank) from ds"


def _dense_docs(t) -> DataFrame:
    """The vector with an item's id is its question's, that with a document's id its text's."""
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = t("benchmark").select("item_id").join(t("embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    return dense.top(asked, vectors.join(t("documents").select("doc_id").distinct(), "doc_id", "left_semi"), 100, "item_id", "doc_id")


def _fused(t, how: str = "sum") -> DataFrame:
    return fusion.fuse([fusion.votes(_bm25(t), "item_id", "doc_id"), fusion.votes(_dense_docs(t), "item_id", "doc_id")], "item_id", "doc_id", how)


@query(f"with {_CHANNELS}, {_FUSED.format(how='sum', votes=_TWO)} select item_id, doc_id, score, rank from f where rank < 20")
def rrf_fuse(spark, t):
    """Reciprocal-rank fusion of BM25 and cosine, ranks from 0."""
    return _fused(t).where("rank < 20").withColumn("rank", F.col("rank").cast("long"))


@query(f"with {_CHANNELS}, {_FUSED.format(how='max', votes=_TWO)} select item_id, doc_id, score, rank from f where rank < 20")
def max_fuse_ablation(spark, t):
    """The best vote instead of the sum."""
    return _fused(t, "max").where("rank < 20").withColumn("rank", F.col("rank").cast("long"))


_REWRITES = "rq as (select item_id * 10 as qid, text from benchmark union all select item_id * 10 + 1, split_part(text, '.', 1) from benchmark union all select item_id * 10 + 2, split_part(text, '.', 2) from benchmark)"


@query(f"with {_REWRITES}, {S.bm25('rb', 'documents', 'doc_id', 'rq', 'qid')}, {_FUSED.format(how='sum', votes='select qid // 10 as item_id, doc_id, (case when qid % 10 = 0 then 1.0::double else 0.6::double end) / (60 + rank) as vote from rb')} select item_id, doc_id, score, rank from f where rank < 20")
def rrf_weighted_rewrites(spark, t):
    """A question at weight 1 fused with two rewrites (its first two sentences) at 0.6."""
    parts = F.array(F.col("text"), F.split_part("text", F.lit("."), F.lit(1)), F.split_part("text", F.lit("."), F.lit(2)))
    asked = t("benchmark").select("item_id", F.posexplode(parts).alias("pos", "text")).select((F.col("item_id") * 10 + F.col("pos")).alias("qid"), "text")
    ranked = lexical.search(_index(t), asked, "doc_id", "qid")
    ranked = ranked.withColumns({"item_id": F.floor(F.col("qid") / 10).cast("long"), "w": F.when(F.col("qid") % 10 == 0, 1.0).otherwise(fusion.REWRITE)})
    return fusion.fuse([fusion.votes(ranked, "item_id", "doc_id", "w")], "item_id", "doc_id").where("rank < 20").withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- seats

#: Documents of a source are neighbours by doc_id: the source stands for the document, doc_id for the place in it.
_HITS = f"{_CHANNELS}, {_FUSED.format(how='sum', votes=_TWO)}, h as (select f.*, source, lang from f join documents using (doc_id))"
_GREEDY = """k as (select item_id, source, unnest(list_reduce(list({'r': rank, 's': doc_id} order by rank), lambda a, x: case when len(list_filter(a, lambda y: abs(y.s - x.s) <= 2)) > 0 then a else list_append(a, x) end,
    []::struct(r bigint, s bigint)[])).s as doc_id from h group by item_id, source), kept as (select h.* from h join k using (item_id, source, doc_id))"""
_CAPPED = "capped as (select * from (select *, row_number() over (partition by item_id, source order by rank) as n from kept) where n <= 3)"


def _hits(t) -> DataFrame:
    return _fused(t).join(t("documents").select("doc_id", "source", "lang"), "doc_id")


def _kept(t) -> DataFrame:
    return select.drop_adjacent(_hits(t), "item_id", "source", "doc_id")


@query(f"with {_HITS}, {_GREEDY} select item_id, doc_id, source, rank from kept")
def adjacent_dedup(spark, t):
    """Fused hits without neighbours of better kept hits."""
    return _kept(t).select("item_id", "doc_id", "source", F.col("rank").cast("long").alias("rank"))


@query(f"with {_HITS}, {_GREEDY}, {_CAPPED} select item_id, doc_id, source, rank from capped")
def doc_cap3(spark, t):
    """At most three hits of a document."""
    return select.cap_documents(_kept(t), "item_id", "source").select("item_id", "doc_id", "source", F.col("rank").cast("long").alias("rank"))


@query(f"with {_HITS} select item_id, lang, doc_id, place from (select *, row_number() over (partition by item_id, lang order by rank) - 1 as place from h) where place < 2")
def company_topn(spark, t):
    """The two best hits of each company."""
    return select.best_of_each(_hits(t), 2, ["item_id", "lang"], [F.col("rank")]).select("item_id", "lang", "doc_id", F.col("place").cast("long").alias("place"))


@query(f"with {_HITS}, p as (select * from (select *, row_number() over (partition by item_id, lang order by rank) - 1 as place from h) where place < 2) select item_id, lang, doc_id, row_number() over (partition by item_id order by place, lang) - 1 as dealt from p")
def round_robin_deal(spark, t):
    """Those dealt in turn, companies by name."""
    picks = select.best_of_each(_hits(t), 2, ["item_id", "lang"], [F.col("rank")])
    return select.deal(picks, "item_id", "lang").select("item_id", "lang", "doc_id", F.col("dealt").cast("long").alias("dealt"))


_SEATS = """own as (select *, case lang when 'de' then 0 else 1 end as pos, row_number() over (partition by item_id, lang order by rank) - 1 as i from {hits} where lang in ('de', 'fr')),
    claims as (select item_id, doc_id, 1 as phase, i as a, pos as b from own where i < 4 union all select item_id, doc_id, 2, rank, 0 from {hits}),
    best as (select item_id, doc_id, min({{'p': phase, 'a': a, 'b': b}}) as c from claims group by all),
    seats as (select * from (select *, row_number() over (partition by item_id order by c, doc_id) - 1 as seat from best) where seat < 8)"""


def _named(spark, t) -> DataFrame:
    companies = values(spark, [(c, k) for k, c in enumerate(NAMED)], "lang string, position int")
    return t("benchmark").select("item_id").crossJoin(F.broadcast(companies))  # two rows


@query(f"with {_HITS}, {_SEATS.format(hits='h')} select item_id, seat, doc_id, lang from seats join h using (item_id, doc_id)")
def seat_mix(spark, t):
    """Eight seats: named companies in turn, then the rest by rank."""
    hits = _hits(t).withColumn("anchor_rank", F.lit(None).cast("int"))
    return select.seat(hits, _named(spark, t), 8, "item_id", "doc_id", "lang").select("item_id", F.col("seat").cast("long").alias("seat"), "doc_id", "lang")


_LABEL = "trim(regexp_replace(regexp_replace(trim(split_part(l, ' | ', 1)), '^(?:[（(][一二三四五六七八九十]+[）)]|[一二三四五六七八九十]+[）)、.．])\\s*', ''), '^[：: ]+|[：: ]+$', '', 'g'))"
_ANCHORED = f"""an(anchor) as (values ('ed'), ('the')), ln as (select doc_id, unnest(string_split(text, chr(10))) as l from documents where contains(text, ' | ')),
    ah as (select item_id, doc_id, count(*) as anchor_hits from benchmark, ln, an where contains(l, ' | ') and ends_with({_LABEL}, anchor) group by all),
    ac as (select ah.*, row_number() over (partition by item_id order by anchor_hits desc, coalesce(bm.rank, 100), doc_id) - 1 as rank from ah left join bm using (item_id, doc_id))"""


def _anchors(spark, t) -> DataFrame:
    return t("benchmark").select("item_id").crossJoin(F.broadcast(values(spark, [(a,) for a in ANCHORS], "anchor string")))  # two rows


@query(f"with {_BM25}, {_ANCHORED} select item_id, doc_id, anchor_hits, rank from ac")
def anchor_channel(spark, t):
    """Documents with rows whose label ends with an anchor; the rows of this corpus have no numbers."""
    return retrieve.anchor_channel(t("documents"), _anchors(spark, t), _bm25(t), "item_id", "doc_id", numbered=False).withColumn("rank", F.col("rank").cast("long"))


_COMPANIES = """sm as (select item_id, d.doc_id, lang, round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 6) as sim from a, v join documents d on d.doc_id = v.doc_id where lang in ('de', 'fr')),
    p as (select * from (select *, case lang when 'de' then 0 else 1 end as pos, row_number() over (partition by item_id, lang order by sim desc, doc_id) - 1 as place from sm) where place < 4),
    cc as (select item_id, doc_id, lang, row_number() over (partition by item_id order by place, pos) - 1 as rank from p)"""
_FIVE = _TWO + " union all select item_id, doc_id, 1.0::double / (60 + rank) from ac union all select item_id, doc_id, 1.0::double / (60 + rank) from cc union all select qid // 10, doc_id, 0.6::double / (60 + rank) from rb"


def _rewrites(t) -> DataFrame:
    """A question's first two sentences stand for what a model would write."""
    parts = F.array(F.split_part("text", F.lit("."), F.lit(1)), F.split_part("text", F.lit("."), F.lit(2)))
    return t("benchmark").select("item_id", F.posexplode(parts).alias("pos", "text"))


@query(
    f"""with {_CHANNELS}, {_ANCHORED}, {_COMPANIES}, {_REWRITES}, rw as (select * from rq where qid % 10 > 0), {S.bm25('rb', 'documents', 'doc_id', 'rw', 'qid')}, {_FUSED.format(how='sum', votes=_FIVE)},
    h as (select f.*, documents.source, documents.lang, ac.rank as ar, cc.rank as cr from f join documents using (doc_id) left join ac using (item_id, doc_id) left join cc using (item_id, doc_id)), {_GREEDY},
    capped as (select * from (select *, row_number() over (partition by item_id, source, ar is not null order by rank) as n from kept) where ar is not null or n <= 3),
    own as (select *, case lang when 'de' then 0 else 1 end as pos, row_number() over (partition by item_id, lang order by rank) - 1 as i from capped where lang in ('de', 'fr')),
    anch as (select *, row_number() over (partition by item_id order by ar, rank) - 1 as o from capped where ar is not null),
    claims as (select item_id, doc_id, 0 as phase, o as a, 0 as b from anch where o < 4 union all select item_id, doc_id, 1, i, pos from own where i < 4 union all select item_id, doc_id, 2, rank, 0 from capped),
    best as (select item_id, doc_id, min({{'p': phase, 'a': a, 'b': b}}) as c from claims group by all),
    seats as (select * from (select *, row_number() over (partition by item_id order by c, doc_id) - 1 as seat from best) where seat < 8)
    select item_id, seat, doc_id, capped.score, bm.rank as bm25_rank, ds.rank as dense_rank, ds.sim as dense_sim, ar as anchor_rank, cr as company_rank,
        case when bm.rank is null and ds.rank is null and ar is null and cr is null then '改写' else (case when bm.rank is not null then 'bm25' else '' end) || (case when ds.rank is not null then '+dense' else '' end) || (case when ar is not null then '+锚定' else '' end) || (case when cr is not null then '+公司' else '' end) end as channels,
        lang || '|' || capped.source || ' · ' || 'p' || doc_id as cite
    from seats join capped using (item_id, doc_id) left join bm using (item_id, doc_id) left join ds using (item_id, doc_id)"""
)
def hybrid_search(spark, t):
    """BM25, cosine, anchors, named companies and rewrites fused, neighbours and documents thinned, eight seats a question, with citations."""
    docs = t("documents")
    chunks = docs.select("doc_id", "text", "source", F.col("lang").alias("company"))
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = t("benchmark").select("item_id").join(t("embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    named = _named(spark, t).withColumnRenamed("lang", "company")
    rows = retrieve.search(chunks, _index(t), vectors, t("benchmark"), asked, named, "item_id", "doc_id", "source", "doc_id", anchors=_anchors(spark, t), numbered=False, store=Store(spark, "search"), rewrites=_rewrites(t))
    blank = F.lit("")
    parts = {c: blank for c in ("title", "table_title", "section", "date", "period", "amount_unit")} | {"company": F.col("company"), "source": F.col("source"), "page_start": F.col("doc_id"), "page_end": F.col("doc_id")}
    ranks = {c: F.col(c).cast("long") for c in ("seat", "bm25_rank", "dense_rank", "anchor_rank", "company_rank")}
    return rows.withColumns(ranks | {"cite": T.cite(parts)}).select("item_id", "seat", "doc_id", "score", "bm25_rank", "dense_rank", "dense_sim", "anchor_rank", "company_rank", "channels", "cite")


@query(f"with {_DOCVEC}, {_COMPANIES} select item_id, doc_id, lang, rank from cc")
def company_channel(spark, t):
    """Of each named company its best by cosine on the question, dealt in turn."""
    chunks = t("documents").select("doc_id", F.col("lang").alias("company"))
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = t("benchmark").select("item_id").join(t("embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    picks = retrieve.company_picks(chunks, vectors, asked, _named(spark, t).withColumnRenamed("lang", "company"), 8, "item_id", "doc_id")
    return picks.select("item_id", "doc_id", F.col("company").alias("lang"), F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- chunks


def _pages(t) -> DataFrame:
    return t("documents").select("doc_id", "source", F.lit(1).alias("page"), "text")


#: The corpus has no headings and calibers of its own, so queries on them put made-up ones in front of each text.
_HEADED = "hdoc as (select doc_id, 'Item ' || doc_id % 20 || '. ' || text as text from documents)"
_CALIBERED = "select doc_id, (2000 + doc_id % 30) || '年半年度 ' || (1999 + doc_id % 30) || '年度' || chr(10) || '单位：' || ['元', '万元', '亿元'][doc_id % 3 + 1] || chr(10) || '合并利润表' || chr(10) || text as text from documents"


def _headed(t) -> DataFrame:
    return t("documents").select("doc_id", "source", F.lit(1).alias("page"), F.concat(F.lit("Item "), (F.col("doc_id") % 20).cast("string"), F.lit(". "), F.col("text")).alias("text"))


_LINES = "ln as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as line from documents), nl as (select doc_id, line, raw, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as x from ln)"


def _section_sql() -> str:
    def cases(of: str, patterns: tuple[str, ...], level: int) -> str:
        return " ".join(f"when regexp_matches({of}, {S.quoted(p)}) then {{'level': {level}, 'title': left(trim(regexp_replace(concat_ws(' ', regexp_extract({of}, {S.quoted(p)}, 1), regexp_extract({of}, {S.quoted(p)}, 2)), '\\s+', ' ', 'g')), 80)}}" for p in patterns)

    none = "{'level': 0, 'title': ''}"
    return f"case when length(x) <= 46 then case {cases('x', T.HEADINGS, 1)} {cases('x', T.SUBHEADINGS, 2)} else {none} end else case {cases('left(x, 220)', T.LEADS, 1)} else {none} end end"


_SECTIONS = f"{_HEADED}, {_LINES.replace('from documents', 'from hdoc')}, hd as (select doc_id, line, raw, {_section_sql()} as h from nl)"


@query(f"with {_SECTIONS} select doc_id, line, h.level as level, h.title as title from hd where h.level > 0")
def line_sections(spark, t):
    """Lines that are headings."""
    return chunking.lines(_headed(t)).where("level > 0").select("doc_id", F.col("line").cast("long").alias("line"), "level", "title")


@query(f"with {_SECTIONS} select doc_id, line, coalesce(last_value(case when h.level > 0 then h.title end ignore nulls) over w, '') as section, coalesce(last_value(case when h.level = 1 then h.title end ignore nulls) over w, '') as major from hd window w as (partition by doc_id order by line rows between unbounded preceding and current row)")
def section_carry(spark, t):
    """The heading each line stands under."""
    return chunking.carry_sections(chunking.lines(_headed(t))).select("doc_id", F.col("line").cast("long").alias("line"), "section", "major")


_SENTENCES = "regexp_replace(regexp_replace(x, '([。！？；])', '\\1' || chr(1), 'g'), '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g')"
_UNITS = f"""{_LINES}, nf as (select * from nl where x <> '' and not regexp_matches(x, '^[0-9]{{1,4}}\\s*/\\s*[0-9]{{1,4}}$')),
    un as (select doc_id, line, trim(unnest(case when contains(x, ' | ') then [x] else string_split({_SENTENCES}, chr(1)) end)) as unit from nf)"""


@query(f"with {_UNITS} select doc_id, unit, count(*) as n from un where unit <> '' group by all")
def sentence_units(spark, t):
    """Atomic units of all documents."""
    return t("documents").select("doc_id", F.explode(T.units(F.col("text"))).alias("unit")).groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_LINES} select source, count(*) filter (x = '') as blank, count(*) filter (regexp_matches(x, '^[0-9]{{1,4}}\\s*/\\s*[0-9]{{1,4}}$')) as footers, count(*) as n from nl join documents using (doc_id) group by all")
def footer_drop(spark, t):
    """Lines, blank ones and page footers of each source."""
    rows = t("documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("source").agg(F.count_if(T.normalized(F.col("line")) == "").alias("blank"), F.count_if(T.is_footer(F.col("line"))).alias("footers"), F.count(F.lit(1)).alias("n"))


@query()
def chunk_pack(spark, t):
    """All documents in chunks of 800 characters with 120 of overlap."""
    return chunking.chunk(_headed(t))


@query("with ln as (select doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as line from documents), k as (select *, row_number() over (partition by doc_id order by line) - 1 as seq from ln where length(text) >= 40) select doc_id, line, seq, doc_id || '::' || lpad(seq::varchar, 5, '0') as chunk_id, length(text) as chars from k")
def drop_tiny_seq(spark, t):
    """Lines of 40 characters or more, numbered after the others are dropped."""
    rows = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return chunking.number_chunks(rows, "doc_id", ["line"]).select("doc_id", F.col("line").cast("long").alias("line"), F.col("seq").cast("long").alias("seq"), "chunk_id", F.length("text").cast("long").alias("chars"))


def _first_distinct(pattern: str, group: int, most: int, of: str = "text") -> str:
    found = f"list_transform(regexp_extract_all({of}, {S.quoted(pattern)}, {group}), lambda z: trim(regexp_replace(z, '\\s+', ' ', 'g')))"
    kept = f"list_filter({found}, lambda z: z <> '')"
    return f"array_to_string(list_filter({kept}, lambda z, i: list_position({kept}, z) = i)[:{most}], '／')"


_TITLES = f"array_to_string(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda z: regexp_matches(z, {S.quoted(T.TABLE_TITLE)})), lambda z: trim(z)), lambda z, i: i = 1), '／')"


@query(f"select doc_id, {_first_distinct(T.PERIOD, 0, 4)} as period, {_first_distinct(T.AMOUNT_UNIT, 1, 2)} as amount_unit, {_TITLES} as table_title from ({_CALIBERED})")
def caliber_fields(spark, t):
    """Periods, amount units and table titles that texts name."""
    k = F.col("doc_id") % 30
    unit = F.element_at(F.array(F.lit("元"), F.lit("万元"), F.lit("亿元")), (F.col("doc_id") % 3 + 1).cast("int"))
    front = F.concat((2000 + k).cast("string"), F.lit("年半年度 "), (1999 + k).cast("string"), F.lit("年度\n单位："), unit, F.lit("\n合并利润表\n"))
    return t("documents").select("doc_id", T.caliber(F.concat(front, F.col("text"))).alias("c")).select("doc_id", "c.*")


@query(
    """with p as (select source as doc_id, doc_id as seq, case when contains(text, ' | ') then left(text, 12) else '' end as title, doc_id // 5 as page from documents),
    c as (select *, last_value(case when title <> '' then {'t': title, 'p': page} end ignore nulls) over (partition by doc_id order by seq rows between unbounded preceding and current row) as l from p)
    select doc_id, seq, case when title <> '' then title when page - l.p <= 3 then l.t else '' end as table_title from c"""
)
def table_title_carry(spark, t):
    """Titles carried over up to three pages; a source stands for a document and five texts for a page."""
    page = F.floor(F.col("doc_id") / 5)
    rows = t("documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("seq"), F.when(F.contains("text", F.lit(" | ")), F.substring("text", 1, 12)).otherwise("").alias("table_title"), page.alias("page_start"), page.alias("page_end"))
    return chunking.carry_titles(rows).select("doc_id", "seq", "table_title")


# ---------------------------------------------------------------- audits


def _files(t) -> DataFrame:
    return t("documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))


_ORDER = "(list_position([" + ", ".join(map(S.quoted, SOURCES)) + "], source))"
_WINNERS = f"f as (select doc_id, source, sha256(text) as h from documents), w as (select h, arg_min(source, {_ORDER} * 1000) as winner, count(distinct source) as n from f group by h having count(distinct source) >= 2)"


@query(f"with {_WINNERS} select d.doc_id, d.source from documents d where doc_id not in (select doc_id from f join w using (h) where source <> winner)")
def dedupe_cross_source(spark, t):
    """Documents without copies that another source has by right."""
    return audit.dedup_across_sources(t("documents").select("doc_id", "source"), _files(t), order=SOURCES)


@query(f"with {_WINNERS} select source, winner, count(*) as n_lost from f join w using (h) where source <> winner group by all")
def dedupe_report(spark, t):
    """How many documents each source loses to which."""
    return _files(t).join(audit.dedup_plan(_files(t), order=SOURCES), "sha256").where("source <> winner").groupBy("source", "winner").agg(F.count(F.lit(1)).alias("n_lost"))


@query(
    """with h as (select distinct lang as company, case when source = 'src0' then 'a' else 'b' end as source, sha1(text) as h from documents), a as (select * from h where source = 'a'), b as (select * from h where source = 'b')
    select a.company, count(*) as n_left, count(b.h) as n_shared, round(count(b.h) / count(*), 6) as ratio from a left join b on a.company = b.company and a.h = b.h group by a.company"""
)
def dup_text_ratio(spark, t):
    """Of the first source's distinct texts, how many the others have, by language."""
    rows = t("documents").select(F.col("lang").alias("company"), F.when(F.col("source") == "src0", "a").otherwise("b").alias("source"), "text")
    return audit.shared_ratio(rows, "a", "b")


@query("with o as (select sha1(text) as h, min(doc_id) as reuse from documents where source <> 'src0' group by all) select d.doc_id, sha1(text) as h, reuse from documents d left join o on sha1(d.text) = o.h")
def reuse_plan(spark, t):
    """For each document the first one of the other sources that has its text already."""
    docs = t("documents")
    return audit.reuse_plan(docs, docs.where("source <> 'src0'"), "doc_id", "doc_id")


@query("with o as (select distinct sha1(text) as h from documents where source <> 'src0'), m as (select distinct sha1(text) as h from documents where sha1(text) not in (select h from o)) select left(h, 2) as part, count(*) as n, " + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * k}, 8))::bigint)::bigint as sum_{k}" for k in range(5)) + " from m group by all")
def plan_fingerprint(spark, t):
    """A fingerprint of the texts that are to be computed, by the first two digits of their hashes: sums of parts of them, in any order."""
    docs = t("documents")
    todo = audit.reuse_plan(docs, docs.where("source <> 'src0'"), "doc_id", "doc_id").where("reuse is null").select("h").distinct()
    return todo.groupBy(F.substring("h", 1, 2).alias("part")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long")).alias(f"sum_{k}") for k in range(5)])


_PAIRS = " union all ".join(
    f"select '{a}' as left, '{b}' as right, count(distinct x.k) as n_left, count(distinct x.k) filter (y.k is null) as n_only_left from (select {ka} as k from {a}) x left join (select distinct {kb} as k from {b}) y on x.k = y.k"
    for a, ka in (("documents", "doc_id"), ("embeddings", "vec_id"), ("labels", "doc_id"))
    for b, kb in (("documents", "doc_id"), ("embeddings", "vec_id"), ("labels", "doc_id"))
    if a != b
).replace("as left", 'as "left"').replace("as right", 'as "right"')


@query(_PAIRS)
def index_reconcile(spark, t):
    """Keys that one of the tables has and another lacks."""
    return audit.reconcile({"documents": t("documents").select("doc_id"), "embeddings": t("embeddings").select(F.col("vec_id").alias("doc_id")), "labels": t("labels").select("doc_id")}, "doc_id")


@query(
    """with e as (select doc_id as path, n_chars as bytes, sha256(text) as s from documents where source <> 'src1'), a as (select doc_id as path, case when source = 'src2' then n_chars + 1 else n_chars end as bytes, case when source = 'src3' then sha256(text || 'x') else sha256(text) end as s from documents where source <> 'src4')
    select coalesce(e.path, a.path) as path, case when a.path is null then 'missing' when e.path is null then 'extra' when e.bytes is distinct from a.bytes then 'size' when e.s is distinct from a.s then 'hash' else 'ok' end as state from e full join a on e.path = a.path"""
)
def hash_verify(spark, t):
    """Two manifests of the documents, of which one was tampered with by source."""
    docs = t("documents")
    expected = docs.where("source <> 'src1'").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    actual = docs.where("source <> 'src4'").select(F.col("doc_id").alias("path"), F.expr("case when source = 'src2' then n_chars + 1 else n_chars end").alias("bytes"), F.expr("case when source = 'src3' then sha2(concat(text, 'x'), 256) else sha2(text, 256) end").alias("sha256"))
    return audit.compare_manifests(expected, actual)


@query(
    """with f as (select *, doc_id || case when n_chars > 2000 then '（更新后）' else '' end as name, case when n_chars > 2000 then '更新后' else '原件' end as v, doc_id // 4 as y from documents),
    j as (select a.lang as company, a.source as kind, a.y as year, a.name, b.name as other, sha256(a.text) = sha256(b.text) as same_bytes, a.n_chars = b.n_chars as same_pages,
        row_number() over (partition by a.lang, a.source, a.y, a.name order by coalesce(a.v = b.v, false) desc, b.name) as k from f a left join f b on a.lang = b.lang and a.source = b.source and a.y = b.y and b.n_chars > 300)
    select company, kind, year, name, coalesce(other, '') as other, coalesce(same_bytes::varchar, 'none') as same_bytes, coalesce(same_pages::varchar, 'none') as same_pages from j where k = 1"""
)
def crosscheck_versions(spark, t):
    """Files of one channel beside those of another, version tags first."""
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("n_chars") > 2000, "（更新后）").otherwise(""))
    rows = t("documents").select(F.col("lang").alias("company"), F.col("source").alias("kind"), F.floor(F.col("doc_id") / 4).alias("year"), name.alias("name"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("pages"))
    found = audit.cross_check(rows, rows.where("pages > 300"))
    return found.withColumns({"other": F.coalesce("other", F.lit(""))} | {c: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("same_bytes", "same_pages")})


# ---------------------------------------------------------------- ledgers

@query(f"select doc_id, number, count(*) as n from (select doc_id, unnest({S.numbers('text')}) as number from documents) group by all")
def value_numbers(spark, t):
    """Numbers that claim a fact, with the documents that have them."""
    rows = t("documents").select("doc_id", F.explode(T.value_numbers(F.col("text"))).alias("number"))
    return rows.groupBy("doc_id", "number").agg(F.count(F.lit(1)).alias("n"))


_KEYS = f"list_transform({S.numbers('q')}, lambda z: replace(z, ',', ''))"


@query(
    f"""with {_BM25}, h as (select item_id as query_id, rank as seat, d.text as text from bm join documents d using (doc_id) where rank < 10), said as (select h.query_id, h.text as ans, b.text as q from h join benchmark b on b.item_id = h.query_id where seat = 0),
    n as (select distinct query_id, number from (select query_id, {_KEYS} as asked, unnest({S.numbers('ans')}) as number from said) where not list_contains(asked, replace(number, ',', ''))),
    f as (select distinct query_id, seat + 1 as seat, replace(x, ',', '') as key from (select query_id, seat, unnest({S.numbers('text')}) as x from h))
    select n.query_id, number, coalesce(string_agg(seat::varchar, ',' order by seat), '') as seats from n left join f on f.query_id = n.query_id and f.key = replace(number, ',', '') group by all"""
)
def number_attribution(spark, t):
    """The first hit of each question as its answer: the seats of the first ten hits that have each of its numbers."""
    hits = _bm25(t).where("rank < 10").join(t("documents").select("doc_id", "text"), "doc_id").select(F.col("item_id").alias("query_id"), F.col("rank").alias("seat"), "text")
    said = hits.where("seat = 0").select("query_id", F.col("text").alias("ans")).join(t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id")
    return judge.attribute_numbers(said, hits).select("query_id", "number", F.array_join(F.transform("seats", lambda s: s.cast("string")), ",").alias("seats"))


def _specs(t) -> DataFrame:
    words = F.filter(F.split("text", r"[^A-Za-z]+"), lambda w: F.length(w) >= 4)
    none = "cast(null as {})".format
    return t("benchmark").select(
        F.col("item_id").alias("n"), F.slice(words, 1, 2).alias("must"), F.lit(2).alias("min_companies"), F.create_map(F.lit("A"), F.lit(3)).alias("need_lib"), F.expr(none("string")).alias("forbid_lib"),
        F.create_map(F.lit("en"), F.get(words, 0)).alias("require_companies"), F.create_map(F.lit("en"), F.lit(4)).alias("min_from_company"), F.lit(False).alias("must_fail"),
    )


def _seen(t) -> DataFrame:
    return _bm25(t).where("rank < 10").join(t("documents"), "doc_id").select(F.col("item_id").alias("n"), "text", F.col("lang").alias("company"), "source")


def _library() -> Column:
    return F.when(F.col("source").isin("src0", "src1", "src2", "src3"), "A").otherwise("B")


def _recall(t) -> DataFrame:
    return judge.recall(_specs(t), _seen(t), lib=_library())


_MUST = f"""with {_BM25}, sp as (select item_id as n, unnest(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: length(w) >= 4)[:2]) as w from benchmark),
    hit as (select item_id as n, text, lang as company, source, case when source in ('src0', 'src1', 'src2', 'src3') then 'A' else 'B' end as lib from bm join documents using (doc_id) where rank < 10),
    m as (select n, w, coalesce(bool_or(contains(text, w)), false) as yes from sp left join hit using (n) group by all), mm as (select n, bool_and(yes) as ok_must from m group by n),
    fw as (select item_id as n, list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: length(w) >= 4)[1] as w from benchmark),
    s as (select b.n, count(distinct company) >= 2 as ok_companies, count(distinct source) filter (lib = 'A') >= 3 as ok_libs, count(*) filter (company = 'en') >= 4 as ok_from, coalesce(bool_or(company = 'en' and contains(text, w)), false) as ok_required from fw b left join hit using (n) group by b.n),
    r as (select n, ok_must, ok_companies, ok_libs, true as ok_forbid, ok_from, ok_required, ok_must and ok_companies and ok_libs and ok_from and ok_required as ok_recall from mm join s using (n))"""


@query(f"{_MUST} select n, ok_must from r")
def recall_must(spark, t):
    """Whether the hits have each of a question's strings."""
    return _recall(t).select("n", "ok_must")


@query(f"{_MUST} select * from r")
def recall_structural(spark, t):
    """All conditions on the hits."""
    return _recall(t)


@query(f"{_MUST}, v as (select n, contains((select text from benchmark where item_id = r.n), 'the') as ok_answer, ok_recall from r) select count(*) as n, count(*) filter (ok_recall) as n_recall, count(*) filter (ok_answer) as n_answer, count(*) filter (ok_recall and ok_answer) as n_both from v")
def ledger_totals(spark, t):
    """Questions that pass on recall, on a stand-in for the answer, on both."""
    answers = t("benchmark").select(F.col("item_id").alias("n"), F.contains("text", F.lit("the")).alias("ok_answer"))
    return judge.ledger(_recall(t), answers, "n")


@query("select item_id, count(*) as n_chunks from benchmark b join documents d on d.text ilike '%' || split_part(b.text, ' ', 1) || ' ' || split_part(b.text, ' ', 2) || '%' group by all")
def criterion_breadth(spark, t):
    """How many documents contain the first two words of an item, in any case."""
    asked = t("benchmark").select("item_id", F.lower(F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))).alias("w"))
    texts = t("documents").select(F.lower("text").alias("x"))
    found = select.in_blocks(asked, "item_id", lambda block: texts.join(F.broadcast(block), F.contains("x", F.col("w"))))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_chunks"))


@query(
    rf"""with t as (select a.conv_id * 1000 + a.turn as query_id, u.text as q, a.text as ans from conversations a join conversations u on u.conv_id = a.conv_id and u.turn + 1 = a.turn where a.role = 'assistant' and u.role = 'user'),
    o as (select query_id, count(distinct number) as n from (select query_id, {_KEYS} as asked, unnest({S.numbers('ans')}) as number from t) where not list_contains(asked, replace(number, ',', '')) group by query_id),
    b as (select query_id, regexp_replace(q, '\s+', '', 'g') as q, regexp_replace(ans, '\s+', '', 'g') as a, regexp_replace(split_part(q, ' ', 1), '\s+', '', 'g') as w from t),
    m as (select query_id, (not contains(case when q = '' then a else replace(a, q, '') end, w))::bigint as n_missing from b)
    select query_id, coalesce(n, 0) = 0 and n_missing = 0 as ok_answer, coalesce(n, 0) as n_orphans, n_missing from m left join o using (query_id)"""
)
def answer_judge(spark, t):
    """Verdicts on assistant turns as answers to the user turn before them, with that turn as their only seat."""
    turns = t("conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    said = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "q", F.col("text").alias("ans"), F.array(F.get(F.split("q", " "), 0)).alias("must_ans"), F.lit(False).alias("must_fail"))
    hits = said.select("query_id", F.lit(0).alias("seat"), F.col("q").alias("text"), F.lit("").alias("company"), F.lit("").alias("source"))
    return judge.judge_answers(said, hits).select("query_id", "ok_answer", F.size("orphans").cast("long").alias("n_orphans"), F.size("missing").cast("long").alias("n_missing"))


# ---------------------------------------------------------------- sources


@query()
def html_text_blocks(spark, t):
    """Text blocks of all pages, in order."""
    return html.blocks(t("pages"))


@query("""with l as (select distinct page_id, replace(unnest(regexp_extract_all(html, '(?i)href="([^"]+)"', 1)), '&amp;', '&') as url from pages) select page_id, case when starts_with(url, '//') then 'https:' || url else url end as url, regexp_extract(url, '([^/]*)$', 1) as name from l""")
def html_links(spark, t):
    """Links of all pages."""
    return html.links(t("pages"))


@query("select page_id, len(regexp_extract_all(html, '(?i)<script')) as scripts, len(regexp_extract_all(html, '(?i)<style')) as styles, len(regexp_extract_all(html, '<!--')) as comments, len(regexp_extract_all(html, '(?i)<table')) as n_tables from pages")
def html_drop_tags(spark, t):
    """Elements that extraction drops."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return t("pages").select("page_id", n("(?i)<script").alias("scripts"), n("(?i)<style").alias("styles"), n("<!--").alias("comments"), n("(?i)<table").alias("n_tables"))


@query("with p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda z: trim(regexp_replace(z, '\\s+', ' ', 'g'))), lambda z: length(z) >= 2) as ps from documents) select doc_id, unnest(range(1, len(ps) + 1)) as block, unnest(ps) as text from p")
def txt_paragraphs(spark, t):
    """Paragraphs of all documents."""
    return plain.paragraphs(t("documents")).withColumn("block", F.col("block").cast("long"))


_SPACE = "[\\s\\x0B\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(
    f"""with s as (select doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as x, trim(regexp_replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g'), chr(8203), ''), '{_SPACE}', ' ', 'g')) as plain from documents where text is not null)
    select doc_id, 1::bigint as block, case when length(plain) >= 2 then plain else '<R><SECTION><P>' || replace(x, chr(10), '</P><P>') || '</P></SECTION></R>' end as text from s"""
)
def xml_sections(spark, t):
    """Documents wrapped as XML sections of paragraphs, read back."""
    safe = F.regexp_replace(F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    body = F.concat(F.lit("<R><SECTION><P>"), F.array_join(F.split(safe, "\n"), "</P><P>"), F.lit("</P></SECTION></R>"))
    return plain.sections(t("documents").select("doc_id", body.alias("xml"))).withColumn("block", F.col("block").cast("long"))


@query("with r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) select user_id, event_type, event_id, value from r where k = 1")
def latest_per_key(spark, t):
    """The last event of each user and type: a manifest whose last record wins."""
    return audit.latest(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("select o_orderstatus, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_orderstatus order by o_orderdate desc, o_orderkey) as k from orders where o_orderstatus in ('F', 'O')) where k <= 6")
def topn_per_form(spark, t):
    """The six latest orders of two kinds."""
    return tabular.first_of_each(t("orders"), "o_orderstatus", ["F", "O"], 6, [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderstatus", "o_orderkey", "o_totalprice")


@query("select s_suppkey, 1::int as slot, s_name as file from supplier where s_name <> '' union all select s_suppkey, 2::int, s_nationkey::varchar from supplier union all select s_suppkey, 3::int, s_acctbal::varchar from supplier where s_acctbal > 0")
def unpivot_slots(spark, t):
    """Numbered columns to rows, empty ones left out."""
    rows = t("supplier").select("s_suppkey", F.col("s_name").alias("f1"), F.col("s_nationkey").cast("string").alias("f2"), F.expr("case when s_acctbal > 0 then cast(s_acctbal as string) end").alias("f3"))
    return tabular.slots(rows, ["s_suppkey"], ["f"], 3, ["file"])


@query("select event_type, count(*) as n, sum((props->>'k')::bigint)::bigint as k_sum, max((props->>'k')::bigint) as k_max from events group by all")
def json_manifest_scan(spark, t):
    """JSON properties read by a schema."""
    rows = t("events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_sum"), F.max("p.k").alias("k_max"))


# ---------------------------------------------------------------- reports


@query("select case when grouping(source) = 1 then 'all' else source end as source, count(*) as n, sum(length(text))::bigint as chars, sum(len(string_split(text, chr(10))))::bigint as n_lines from documents group by rollup(source)")
def source_rollup(spark, t):
    """Documents, characters and lines of each source, and of all."""
    return profile.totals(t("documents"), "source", {"chars": F.length("text"), "n_lines": F.size(F.split("text", "\n"))})


@query("with r as (select length(text) as size, row_number() over (order by length(text)) - 1 as at_, count(*) over () as n from documents), q(share) as (values (0.1::double), (0.25), (0.5), (0.75), (0.9), (0.99)) select share::double as share, max(size) as size from q join r on at_ = least(n - 1, floor(n * share::double)) group by all")
def size_percentiles(spark, t):
    """Sizes at given shares of all documents."""
    return profile.size_percentiles(t("documents").select(F.length("text").cast("long").alias("size")), "size")


@query("select source, count(*) as n, count(*) filter (text <> '') as with_text, count(*) filter (contains(text, ' | ')) as with_rows, count(*) filter (length(text) > 800) as n_long, count(*) filter (length(text) < 40) as n_tiny, round(avg(length(text)), 6) as mean_chars from documents group by all")
def coverage_counts(spark, t):
    """What documents of each source have."""
    n = F.length("text")
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") != "").alias("with_text"), F.count_if(F.contains("text", F.lit(" | "))).alias("with_rows"), F.count_if(n > 800).alias("n_long"), F.count_if(n < 40).alias("n_tiny"), F.round(F.avg(n), 6).alias("mean_chars"))


@query("with r as (select case when length(text) < 40 then 'tiny text' end as a, case when contains(text, '***') then 'marks in text' end as b, case when contains(text, ' | ') then 'rows of cells' end as c from documents), u as (select a as r from r union all select b from r union all select c from r) select split_part(r, ' ', 1) as reason, count(*) as n from u where r is not null group by all order by n desc, reason limit 8")
def drop_reason_top(spark, t):
    """The commonest reasons, by their first word."""
    x = F.col("text")
    reasons = F.array_compact(F.array(F.when(F.length(x) < 40, "tiny text"), F.when(F.contains(x, F.lit("***")), "marks in text"), F.when(F.contains(x, F.lit(" | ")), "rows of cells")))
    return profile.histogram(t("documents").select(reasons.alias("r")), "r")


@query("select count(*) as n, count(distinct doc_id) as n_docs, count(distinct text) as n_texts, count(distinct source) as n_sources, count(distinct case when lang = 'en' then source end) as n_en_sources from documents")
def corpus_stats(spark, t):
    """Counts and distinct counts, some of them filtered."""
    return t("documents").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("text").alias("n_texts"), F.count_distinct("source").alias("n_sources"), F.count_distinct(F.when(F.col("lang") == "en", F.col("source"))).alias("n_en_sources"))


@query("select lang, count(*) as n_files, count(distinct text) as n_contents, count(distinct source) as n_sources, array_to_string(list_sort(list(distinct source)), ',') as sources, min(n_chars) as first, max(n_chars) as last from documents group by all")
def roster(spark, t):
    """Files, contents, sources and span of each company."""
    return profile.roster(t("documents"), "lang", "source", "n_chars", F.sha2("text", 256))


@query("with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) as label from documents), c as (select doc_id, label, count(*) as n from w group by all having count(*) >= 3) select doc_id, b.label as label, b.n as n from (select doc_id, max({'n': n, 'label': label}) as b from c group by all)")
def label_repeat_fingerprint(spark, t):
    """The word that each document repeats most."""
    return profile.commonest(t("documents"), "doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)))


@query("with r as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from documents), k as (select unnest(range(5)) as k) select distinct doc_id, source from r, k where n <= 5 or i = (k * n) // 5")
def stratified_sample(spark, t):
    """Five evenly spaced documents of each source."""
    return profile.spread_sample(t("documents").select("doc_id", "source"), "source", "doc_id", 5)


@query("select 'like' as kind, count(*) as n, count(distinct source) as n_sources from documents where text ilike '%the%' and (text ilike '%and%' or text ilike '%apache license%') and lang in ('en', 'de') union all select 'prefix', count(*), count(distinct source) from documents where starts_with(text, 'The')")
def like_filters(spark, t):
    """LIKE, OR, IN and prefix predicates."""
    docs = t("documents")
    some = docs.where(F.col("text").ilike("%the%") & (F.col("text").ilike("%and%") | F.col("text").ilike("%apache license%")) & F.col("lang").isin("en", "de"))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"))
    return count(some, "like").unionByName(count(docs.where(F.startswith("text", F.lit("The"))), "prefix"))


@query("select left(x, 3) as section, count(*) as n from (select unnest(string_split(text, chr(10))) as x from documents) where x like 'Th%' group by all")
def section_prefix_counts(spark, t):
    """Lines by their first letters."""
    lines = t("documents").select(F.explode(F.split("text", "\n")).alias("x"))
    return lines.where(F.startswith("x", F.lit("Th"))).groupBy(F.substring("x", 1, 3).alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query("select b.item_id, d.doc_id from benchmark b join documents d on b.item_id * 25 between d.doc_id and d.doc_id + d.n_chars // 1000")
def page_range_join(spark, t):
    """Documents whose range of pages covers an item's page: ranges are exploded to pages, so the join is by equality."""
    pages = t("documents").select("doc_id", F.explode(F.sequence(F.col("doc_id"), F.col("doc_id") + F.floor(F.col("n_chars") / 1000))).alias("page"))
    return t("benchmark").select("item_id", (F.col("item_id") * 25).alias("page")).join(pages, "page").select("item_id", "doc_id")


@query("select source, count(*) as n from documents group by all order by n desc, source")
def group_order(spark, t):
    """Documents by source, most first."""
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query("select doc_id, kind, year, board, safe, ext from (select doc_id, case when length(text) > 2000 then '半年报' when length(text) > 500 then '年报' end as kind, 2000 + doc_id % 30 as year, case when source like 'src1%' then 'sse' else 'szse' end as board, left(regexp_replace(lang || '/' || source || '?', '[\\\\/:*?\"<>|]', '_', 'g'), 80) as safe, case doc_id % 4 when 0 then 'pdf' when 1 then 'html' when 2 then 'txt' end as ext from documents)")
def title_fields(spark, t):
    """Report kinds, years, boards, file names and extractors from made-up titles of all documents."""
    n, k = F.length("text"), F.col("doc_id")
    title = F.concat((2000 + k % 30).cast("string"), F.lit("年"), F.when(n > 2000, "半年度报告").when(n > 500, "年度报告").otherwise("公告"))
    code = F.when(F.startswith("source", F.lit("src1")), "600000").otherwise("000001")
    path = F.concat(F.lit("a/b."), F.element_at(F.array(*map(F.lit, ("pdf", "HTM", "txt", "doc"))), (k % 4 + 1).cast("int")))
    return t("documents").select("doc_id", T.report_kind(title).alias("kind"), T.report_year(title).cast("long").alias("year"), T.board(code)["column"].alias("board"), T.safe_name(F.concat_ws("/", "lang", F.concat("source", F.lit("?")))).alias("safe"), T.extractor(path).alias("ext"))


@query("select source, count(*) as n from (select arg_min(source, doc_id) as source from documents group by sha256(coalesce(text, ''))) group by source")
def streaming_ingest(spark, t):
    """Documents read as a stream into a table of contents; contents counted by the source of their first document."""
    docs = t("documents")
    root = folder(spark, "ingest")
    landed = docs.inputFiles()[0].rsplit("/", 1)[0]
    pattern = f"{landed}/documents*.parquet" if landed.rsplit("/", 1)[-1] != "documents.parquet" else landed
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(pattern)
    ingest.start(stream, lambda batch, no: ingest.record(batch, no, f"{root}/contents"), f"{root}/state").awaitTermination()
    return ingest.recorded(spark, f"{root}/contents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
