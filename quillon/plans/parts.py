"""Queries of single parts (layouts, grids, listings, stores, questions, answers), registered beside those of the catalogue.

The corpus has no layouts, listings or companies, so these queries make them up from the ids of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import register
from ..functions import text as T
from ..operators import audit, judge, profile
from ..operators.scratch import folder
from ..sources import html, pages, store, tabular
from . import answers, catalog, retrieve
from . import sqltext as S
from .catalog import query

# ---------------------------------------------------------------- layouts and grids

_BLOCK = "named_struct('page', {page}, 'page_height', 1000d, 'x0', 0d, 'y0', {y0}d, 'x1', 200d, 'y1', {y1}d, 'text', cast({text} as string), 'rows', cast({rows} as array<array<string>>))"
_BLOCKS = (
    (1, 100, 200, "null", "array(array('Item', 'Amount'), array(concat('a', doc_id), share))"),
    (1, 120, 140, "'within the table'", "null"),
    (1, 300, 320, "lang", "null"),
    (2, 50, 150, "null", "array(array(concat('b', doc_id), share), array('c', '7%'))"),
    (3, 50, 150, "null", "array(array('one row', 'alone'))"),
    (3, 400, 420, "'end'", "null"),
)


def _layout(docs: DataFrame) -> DataFrame:
    """Three pages a document: a table above text, its continuation without a header, and a table that is none."""
    blocks = ", ".join(_BLOCK.format(page=p, y0=a, y1=b, text=t, rows=r) for p, a, b, t, r in _BLOCKS)
    rows = docs.selectExpr("cast(doc_id as string) as doc_id", "lang", "concat(doc_id % 90, '%') as share")
    return rows.selectExpr("doc_id", f"inline(array({blocks}))")


@query(
    """with d as (select doc_id::varchar as id, lang, (doc_id % 90) || '%' as share from documents)
    select id as doc_id, 1::bigint as page, 'a' || id || ' | Amount ' || share || chr(10) || lang as text, 1::bigint as tables, '' as reasons from d
    union all select id, 2, 'b' || id || ' | Amount ' || share || chr(10) || 'c | Amount 7%', 1, '' from d union all select id, 3, 'end', 0, 'few rows' from d"""
)
def layout_pages(spark, t):
    """Layout blocks to pages: text in a table's box is the table's, headers go on to the next page, bad tables are dropped."""
    found = pages.from_layout(_layout(t("documents")))
    return found.select("doc_id", F.col("page").cast("long").alias("page"), "text", F.col("tables").cast("long").alias("tables"), F.array_join("drop_reasons", ",").alias("reasons"))


@query("select doc_id::varchar as doc_id, case when doc_id % 5 = 0 then 'missing' when doc_id % 7 = 0 then 'broken' when doc_id % 11 = 0 then 'mismatch' else 'ok' end as state from documents")
def page_completeness(spark, t):
    """Documents whose pages are missing, have no trailer, or are not as many as it says."""
    docs, key = t("documents"), F.col("doc_id").cast("long")
    found = pages.from_layout(_layout(docs.where("doc_id % 5 > 0")))
    trailers = pages.trailer(found).where(key % 7 > 0).withColumn("pages", F.col("pages") + F.when(key % 11 == 0, 1).otherwise(0))
    return audit.completeness(docs.select(F.col("doc_id").cast("string").alias("doc_id")), found, trailers)


@query(
    """with d as (select doc_id, lang, n_chars::varchar as n, doc_id::varchar as id from documents)
    select doc_id, 1::bigint as block, 'text' as kind, lang as text, 1::bigint as tables_dropped from d union all select doc_id, 3, 'text', 'end', 1 from d
    union all select doc_id, 2, 'table', 'a' || id || ' | Year ' || n || '.5 | Year ' || n || '.7' || chr(10) || 'a' || id || ' | Year 1.5 | Year 2.5', 1 from d"""
)
def html_table_grid(spark, t):
    """Tables with spans over rows and columns to lines that carry their headers."""
    page = "<p>%s</p><table><tr><th>Item</th><th colspan='2'>Year</th></tr><tr><td rowspan='2'>a%s</td><td>%s.5</td><td>%s.7</td></tr><tr><td>1.5</td><td>2.5</td></tr></table><table><tr><td>one</td></tr></table><p>end</p>"
    n = F.col("n_chars").cast("string")
    made = t("documents").select("doc_id", F.format_string(page, F.col("lang"), F.col("doc_id").cast("string"), n, n).alias("html"))
    return html.blocks(made, "doc_id").select("doc_id", F.col("block").cast("long").alias("block"), "kind", "text", F.col("tables_dropped").cast("long").alias("tables_dropped"))


@query(
    """with r as (select case when doc_id % 2 = 0 then case when doc_id % 3 = doc_id % 5 then 'A' when doc_id % 5 = 4 then 'D' else 'E' end when doc_id % 5 < 4 then 'B' else 'C' end as class from documents)
    select class, count(*) as n, round(count(*) / (select count(*) from documents), 6) as share from r group by class"""
)
def header_classes(spark, t):
    """What a new rule for headers changes against an old one: counts and shares of the classes A to E."""
    k = F.col("doc_id")
    rows = t("documents").select((k % 3).alias("old"), F.when(k % 5 < 4, k % 5).alias("new"), (k % 2 == 0).alias("credible"))
    return profile.header_changes(rows, "old", "new", "credible")


# ---------------------------------------------------------------- listings


@query("select doc_id, unnest(string_split(text, ' ')[:5]) as w, unnest(list_transform(string_split(text, ' ')[:5], lambda z: length(z))) as n from documents")
def zipped_listing(spark, t):
    """Parallel arrays (the first five words and their lengths) to rows."""
    words = F.slice(F.split("text", " "), 1, 5)
    rows = t("documents").select("doc_id", words.alias("w"), F.transform(words, lambda w: F.length(w).cast("long")).alias("n"))
    return tabular.zipped(rows, ["doc_id"], ["w", "n"])


@query(
    """with p as (select page_id, 1990 + page_id % 40 as y from pages), q as (select page_id, case when page_id % 2 = 0 then y || '_r.pdf' else 'own' end as name, case when page_id % 2 = 0 and y >= 2000 then y else 0 end as year from p)
    select page_id, name, year from q where year = 0 or year >= 2015"""
)
def listing_since(spark, t):
    """File names taken from links where a listing has none, and those of 2015 on or without a year."""
    rows = t("pages").select("page_id", F.format_string("http://h.example/a/%d_r.pdf?v=1", F.col("page_id") % 40 + 1990).alias("link"), F.when(F.col("page_id") % 2 == 1, "own").otherwise("").alias("name"))
    return tabular.since(tabular.names_from_urls(rows, "link", "name"), "name", 2015).select("page_id", "name", F.col("year").cast("long").alias("year"))


@query("select o_orderkey, case when o_orderkey % 10 <> 0 and o_orderkey % 3 = 0 then 'effective before publication' else '-' end as note from orders")
def effective_dates(spark, t):
    """Rules that take effect before they are published; dates that are none say nothing."""
    day = F.col("o_orderdate").cast("date")
    effective = F.when(F.col("o_orderkey") % 10 != 0, F.date_add(day, (F.col("o_orderkey") % 3 - 1).cast("int")).cast("string")).otherwise("n/a")
    rules = t("orders").select("o_orderkey", effective.alias("effective_on"), day.cast("string").alias("publication_date"))
    return tabular.odd_dates(rules).select("o_orderkey", F.coalesce("note", F.lit("-")).alias("note"))


# ---------------------------------------------------------------- stores


@query("select 0::bigint as version, source, count(*) as n from documents where source = 'src0' group by all union all select 1, source, count(*) from documents where source <> 'src0' group by all")
def store_versions(spark, t):
    """Two versions of a table side by side, read back: the first by number, the last by default."""
    docs, path = t("documents"), folder(spark, "versions")
    first = store.write_version(docs.where("source = 'src0'"), path)
    store.write_version(docs.where("source <> 'src0'"), path)
    both = store.read_version(spark, path, first).withColumn("version", F.lit(0)).unionByName(store.read_version(spark, path).withColumn("version", F.lit(1)))
    return both.groupBy(F.col("version").cast("long").alias("version"), "source").agg(F.count(F.lit(1)).alias("n"))


@query("select source, count(*) as n, sum(length(text))::bigint as chars from documents where trim(coalesce(text, '')) <> '' and source in ('src1', 'src2') group by source")
def chunk_store(spark, t):
    """A checked store of chunks, of which a filter reads two sources' folders."""
    path = folder(spark, "chunks")
    store.write_chunks(t("documents").where("trim(coalesce(text, '')) <> ''").select(F.col("doc_id").alias("chunk_id"), "source", "text"), path)
    return spark.read.parquet(path).where(F.col("source").isin("src1", "src2")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("select doc_id from documents where doc_id not in (select vec_id from embeddings where label % 2 = 0)")
def left_to_do(spark, t):
    """Documents that a broken-off run over the vectors of even labels has not done."""
    done = t("embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("doc_id"))
    return store.left_to_do(t("documents").select("doc_id"), done, "doc_id")


# ---------------------------------------------------------------- questions

_LINES = "[ '1. ' || split_part(text, '.', 1), '- ' || split_part(text, '.', 2), text, '', '• tail', '4) more', '5、most' ]"


@query(
    f"""with l as (select item_id, text as q, unnest({_LINES}) as x, unnest(range(7)) as i from benchmark), c as (select item_id, q, i, trim(regexp_replace(x, {S.quoted(T.LIST_MARK)}, '')) as x from l),
    k as (select item_id, x, row_number() over (partition by item_id order by i) as pos from c where x <> '' and x <> q and length(x) < 400)
    select item_id as query_id, 0::bigint as pos, 1.0::double as weight, text from benchmark union all select item_id, pos, 0.6::double, x from k where pos <= 3"""
)
def expand_questions(spark, t):
    """Questions with up to three rewrites each, from lines as a model writes them."""
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    first, second = (F.split_part("text", F.lit("."), F.lit(k)) for k in (1, 2))
    lines = F.array(F.concat(F.lit("1. "), first), F.concat(F.lit("- "), second), F.col("text"), F.lit(""), F.lit("• tail"), F.lit("4) more"), F.lit("5、most"))
    found = answers.expand(asked, asked.select("query_id", F.posexplode(lines).alias("pos", "text")))
    return found.withColumn("pos", F.col("pos").cast("long"))


@query("select item_id, array_to_string(list_filter([case when length(w) between 2 and 24 then w end, case when w <> 'ab' then 'ab' end, '营业收入'], lambda z: z is not null), '|') as anchors from (select item_id, split_part(text, ' ', 1) as w from benchmark)")
def question_anchors(spark, t):
    """Terms that questions quote, and metric names they have."""
    asked = F.concat(F.lit("「"), F.split_part("text", F.lit(" "), F.lit(1)), F.lit("」 营业收入 “ab”"))
    return t("benchmark").select("item_id", F.array_join(T.anchors(asked), "|").alias("anchors"))


@query(
    r"""with c as (select company, [left(company, 2)] || list_filter(string_split_regex(company, '[\s()（）]+'), lambda w: length(w) >= 4) as aliases from (select 'c' || n_nationkey || 'x (' || n_name || ')' as company from nation)),
    s as (select s_suppkey, 'How did ' || n_name || ' and c' || s_suppkey % 25 || ' do' as text from supplier join nation on n_nationkey = s_nationkey),
    f as (select s_suppkey, company, list_filter(aliases, lambda a: contains(text, a))[1] as alias from s, c)
    select s_suppkey, company, alias, row_number() over (partition by s_suppkey order by company) - 1 as position from f where alias is not null"""
)
def question_companies(spark, t):
    """Companies that questions name by an alias."""
    nations = t("nation")
    companies = nations.select(F.format_string("c%dx (%s)", "n_nationkey", "n_name").alias("company"))
    asked = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    asked = asked.select("s_suppkey", F.format_string("How did %s and c%d do", F.col("n_name"), F.col("s_suppkey") % 25).alias("text"))
    return retrieve.named_companies(asked, companies, "s_suppkey").withColumn("position", F.col("position").cast("long"))


@query("select doc_id, 1 + doc_id % 2 as n from documents")
def label_rows(spark, t):
    """Rows whose label ends with an anchor: a marker and a colon are no part of it, and a row needs a digit."""
    last = F.when(F.col("doc_id") % 2 == 1, "sub total | 7").otherwise("total | none")
    rows = F.concat(F.lit("x | 5\n一、total： | "), F.col("n_chars").cast("string"), F.lit("\n"), last)
    return t("documents").select("doc_id", T.label_hits(rows, F.lit("total")).cast("long").alias("n"))


@query(
    f"""with {catalog._BM25}, {catalog._ANCHORED.split("ac as")[0].rstrip().rstrip(",")}, sc as (select ah.* from ah join documents using (doc_id) where item_id % 3 > 0 or contains(lang, 'd'))
    select item_id, doc_id, anchor_hits, row_number() over (partition by item_id order by anchor_hits desc, coalesce(bm.rank, 100), doc_id) - 1 as rank from sc left join bm using (item_id, doc_id)"""
)
def anchor_scope(spark, t):
    """The anchor channel, within the named company where a question names one (every third one does)."""
    named = t("benchmark").where("item_id % 3 = 0").select("item_id", F.lit("d").alias("company"))
    chunks = t("documents").withColumnRenamed("lang", "company")
    found = retrieve.anchor_channel(chunks, catalog._anchors(spark, t), catalog._bm25(t), "item_id", "doc_id", numbered=False, scope=named)
    return found.withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- answers

_PAIRS = "t as (select a.conv_id * 1000 + a.turn as query_id, u.text as q, a.text as ans from conversations a join conversations u on u.conv_id = a.conv_id and u.turn + 1 = a.turn where a.role = 'assistant' and u.role = 'user')"


def _turns(t) -> DataFrame:
    turns = t("conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    return turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "q", F.col("text").alias("ans"))


@query(f"with {_PAIRS}, b as (select query_id, regexp_replace(q, '\\s+', '', 'g') as q, regexp_replace(ans, '\\s+', '', 'g') || '[2][1][9]' as a from t) select query_id, case when q = '' then a else replace(a, q, '') end || 'ABs1' || 'CDs2' as domain from b")
def answer_domains(spark, t):
    """What an answer may be judged by: itself without the question, and the companies and sources of the seats it cites."""
    said = _turns(t).withColumn("ans", F.concat("ans", F.lit(" [2] [1] [9]")))
    seats = [F.struct(F.lit(k).alias("seat"), F.lit(c).alias("company"), F.lit(s).alias("source")) for k, c, s in ((0, "A B", "s1"), (1, "C D", "s2"), (2, "E", "s3"))]
    return judge.answer_domain(said, said.select("query_id", F.inline(F.array(*seats))))


@query(
    r"""with h as (select doc_id // 3 as query_id, doc_id % 3 as seat, regexp_replace(text, '^\s+|\s+$', '', 'g') as x from documents), f as (select query_id, min(seat) as seat, arg_min(x, seat) as x from h where x <> '' group by query_id)
    select query_id, coalesce(split_part(regexp_replace(x, '([。！？；.!?])\s', '\1' || chr(10), 'g'), chr(10), 1) || ' [' || (seat + 1) || ']', '材料未覆盖') as ans from (select distinct query_id from h) left join f using (query_id)"""
)
def extractive_answers(spark, t):
    """Answers without a model: the first sentence of the first passage that has one, with its seat."""
    hits = t("documents").select(F.floor(F.col("doc_id") / 3).alias("query_id"), (F.col("doc_id") % 3).alias("seat"), "text")
    asked = hits.select("query_id", F.lit("?").alias("text")).distinct()
    return answers.answer(asked, hits).select("query_id", "ans")


@query("select conv_id, turn, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\[([0-9]{1,3})\\]', '<a href=\"#h\\1\">[\\1]</a>', 'g') || '<a href=\"#h3\">[3]</a> &lt;b&gt;<span class=\"no\">材料未覆盖</span>' as html from conversations")
def rendered_answers(spark, t):
    """Turns as HTML of answers, with links to seats and the refusal marked."""
    return t("conversations").select("conv_id", "turn", T.rendered_answer(F.concat("text", F.lit("[3] <b>" + T.UNCOVERED))).alias("html"))


@query("select doc_id, lang as company, 2::bigint as n from documents union all select doc_id, source, 1 from documents")
def seats_by_company(spark, t):
    """How many seats of a result page each company has."""
    cites = F.format_string("<li><cite>%s|a</cite></li><li><cite>%s|b</cite></li><li><cite>%s|c</cite></li>", "lang", "source", "lang")
    return answers.seats_by_company(t("documents").select("doc_id", cites.alias("html")), "doc_id")


@query(f"{catalog._MUST} select n, n % 2 = 0 or ok_recall as ok_recall from r")
def recall_must_fail(spark, t):
    """Specs that have to fail pass on recall."""
    return judge.recall(catalog._specs(t).withColumn("must_fail", F.col("n") % 2 == 0), catalog._seen(t), lib=catalog._library()).select("n", "ok_recall")


@query(f"select doc_id, len({S.numbers('text')})::bigint as n_numbers, case when doc_id % 2 = 0 then '更新后' else '原件' end as version, 'a' || doc_id as label from documents")
def sql_functions(spark, t):
    """The engine's functions, called from SQL."""
    register.register(spark)
    made = t("documents").selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then concat('r', doc_id, '（更新后）') else 'r' end as name", "concat('（一）a', doc_id, ' | 5') as line")
    return made.selectExpr("doc_id", "cast(size(value_numbers(text)) as long) as n_numbers", "version_tag(name) as version", "row_label(line) as label")
