"""The registered queries of this subpackage and their SQL; each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers

from . import capfilter, piecewise, urlfilter
from .common import Scratch, table
from .huffman import round_trip
from .linededup import dedup_lines
from .packing import pack
from .secrets import BASE, MORE, Ledger, scan_documents
from .simhash import near_duplicates
from .sketch import compare_edited
from .toxicity import fit_labels, held_out, score_documents


def op1_simhash(spark, sf_dir):
    """Near-duplicate components of all documents by SimHash at 4 or fewer differing bits."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op2_url_filters(spark, sf_dir):
    """Verdicts on all pages; the list is that of canonical URLs that were reached through a feed."""
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.feed_list(pages))


def op3_embeddings(spark, sf_dir):
    """Near-duplicate components of all embeddings at a cosine of 0.95 or more."""
    return capfilter.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op4_packing(spark, sf_dir):
    """All documents' tokens packed into sequences of 2048."""
    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_token_ids(spark, sf_dir):
    """All documents' ids, written in the block format and read back."""
    return round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_secrets(spark, sf_dir):
    """Secrets of all documents, found through a ledger that is empty at first."""
    return scan_documents(spark, table(spark, sf_dir, "documents"), Ledger(spark, f"{Scratch(spark, 'ledger').root}/ledger"))


def op6_sketch(spark, sf_dir):
    """Sketches of all documents, compared with edited texts and with next documents."""
    return compare_edited(spark, table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    """All documents scored by a model that is fitted on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_labels(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(spark, docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_sentences", "n_offending")


def op9_pieces(spark, sf_dir):
    """All documents encoded to pieces and decoded again."""
    return piecewise.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_line_dedup(spark, sf_dir):
    """All documents without later occurrences of three-line windows."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_url_filters, op3_embeddings, op4_packing, op5_secrets, op6_sketch, op7_token_ids, op8_toxicity, op9_pieces, op10_line_dedup)}


# ---------------------------------------------------------------- SQL

_EITHER = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """Gaps between matches and running sums, as in the operator; letters in either case are spelt out for RE2."""
    spans = []
    for no, r in enumerate(BASE + MORE):
        p = r.pattern
        if r.kind == "assign":
            words = "|".join(map(_EITHER, ("password", "passwd", "secret", "token", "api_?key")))
            p = p.replace("(?i:(password|passwd|secret|token|api_?key))", f"({words})")
        q = _quoted(p)
        spans.append(f"""
            select doc_id, {no} as no, '{r.kind}' as kind, e - length(m) as s, e from (
                select *, sum(length(g) + length(m)) over (partition by doc_id order by k) as e from (
                    select doc_id, unnest(string_split_regex(t, {q})[:len(regexp_extract_all(t, {q}))]) as g, unnest(regexp_extract_all(t, {q})) as m,
                        unnest(regexp_extract_all(t, {q}, {r.group})) as c, unnest(range(len(regexp_extract_all(t, {q})))) as k from d where regexp_matches(t, {q})))
            where length(c) >= {r.least}""")
    base = len(BASE)
    counts = ", ".join(f"count(*) filter (no = {k}) as n_{r.kind}" for k, r in enumerate(BASE))
    return f"""
        with d as (select doc_id, coalesce(text, '') as t from documents), spans as ({" union all ".join(spans)}),
        f as (select doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, no) filter (no < {base}), '')) as base_sha256,
            string_agg(kind || ':' || s || ':' || e, ',' order by s, no) as spans from spans group by doc_id)
        select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, coalesce(base_sha256, sha256('')) as base_sha256, coalesce(spans, '') as spans, sha256(t) as blob
        from d left join f using (doc_id)"""


_LINES_SQL = """
    with l as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as p from documents),
    w as (select *, x || chr(10) || lead(x) over o || chr(10) || lead(x, 2) over o as win from l window o as (partition by doc_id order by p)),
    r as (select doc_id, p, row_number() over (partition by win order by doc_id, p) > 1 and trim(translate(win, chr(10), '')) <> '' and win is not null as later from w),
    c as (select l.doc_id, l.p, l.x, bool_or(r.later) as gone from l join r on r.doc_id = l.doc_id and r.p between l.p - 2 and l.p group by all)
    select doc_id, coalesce(string_agg(x, chr(10) order by p) filter (not gone), '') as text, count(*)::int as n_lines, (count(*) filter (gone))::int as n_removed from c group by doc_id
    union all select doc_id, null, 0, 0 from documents where text is null"""

_URL_SQL = r"""
    with u as (select page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
    k as (select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') as key from u),
    l as (select distinct key from k where url like '%utm_source=feed%' and key <> ''),
    r(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    j as (select k.*, (select max_by(h || p || ' ' || verdict, length(h || p)) from r where (k.host = h or ends_with(k.host, '.' || h)) and starts_with(k.path, p)) as best from k)
    select page_id, host, path, split_part(best, ' ', 1) as rule, case when best is not null then split_part(best, ' ', 2) when l.key is not null then 'block' else 'allow' end as verdict,
        best is null and l.key is not null as listed
    from j left join l on j.key = l.key"""

#: All pairs; the operator finds those that share a filter, so on tables with many links near 0.95 it may find a few less.
_CAPS_SQL = """
    with recursive e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(embedding) > 0 and list_bool_and([x is not null and isfinite(x) for x in embedding]) and list_bool_or([x <> 0 for x in embedding])),
    n as (select vec_id, v, sqrt(list_dot_product(v, v)) as size from e),
    l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.95),
    r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a)
    select a as vec_id, (select count(*) from l where l.a = r.a) as n_links, min(b) as component_id, a = min(b) as kept from r group by a"""

SQL = {"op2_url_filters": _URL_SQL, "op3_embeddings": _CAPS_SQL, "op5_secrets": _secrets_sql(), "op10_line_dedup": _LINES_SQL}
