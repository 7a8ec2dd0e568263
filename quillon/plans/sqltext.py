"""DuckDB SQL that several oracle queries share; patterns come from the functions that use them."""

from __future__ import annotations

from ..functions import text as T


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = ", ".join(map(quoted, T.STOP))


def tokens(name: str, table: str, key: str, text: str = "text") -> str:
    """CTEs that end in name(key, t, ord): tokens without stop words; ord orders a row's tokens."""
    return f"""
    {name}_raw as (select {key}, lower(x) as t, i from (select {key}, unnest(regexp_extract_all({text}, {quoted(T.TOKEN)})) as x, unnest(range(len(regexp_extract_all({text}, {quoted(T.TOKEN)})))) as i from {table})),
    {name}_all as (
        select {key}, t, i * 1000000 as ord from {name}_raw where not regexp_matches(t, '^[{T.CJK}]') and (not regexp_matches(t, '[0-9]') or regexp_matches(t, '[a-z.]') or regexp_matches(t, '^[0-9]{{5,}}$') or regexp_matches(t, '^(?:19|20)[0-9]{{2}}$'))
        union all select {key}, regexp_extract(t, '^([a-z]{{2,}})[0-9]', 1), i * 1000000 + 1 from {name}_raw where regexp_matches(t, '^[a-z]{{2,}}[0-9]')
        union all select {key}, substr(t, p::int, 2), i * 1000000 + p from (select *, unnest(range(1, greatest(length(t), 2))) as p from {name}_raw where regexp_matches(t, '^[{T.CJK}]'))),
    {name} as (select * from {name}_all where t not in ({STOP}))"""


def bm25(name: str, table: str, key: str, asked: str, query: str, pool: int = 100, text: str = "text") -> str:
    """CTEs that end in name(query, key, score, matched, rank)."""
    return f"""{tokens(f"{name}_d", table, key, text)},
    {name}_tf as (select {key}, t, count(*) as tf from {name}_d group by all),
    {name}_dl as (select b.{key}, coalesce(sum(tf), 0) as dl from {table} b left join {name}_tf f on f.{key} = b.{key} group by all),
    {name}_df as (select t, count(*) as df from {name}_tf group by t having count(*) >= 2 and length(t) > 1),
    {name}_st as (select count(*) as n, avg(dl) as a from {name}_dl),
    {tokens(f"{name}_q", asked, query)},
    {name}_qt as (select {query}, t, min(ord) as ord from {name}_q group by all),
    {name}_sc as (select q.{query}, f.{key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) as score, list(q.t order by q.ord) as matched
        from {name}_qt q join {name}_tf f on f.t = q.t join {name}_df d on d.t = q.t join {name}_dl l on l.{key} = f.{key} cross join {name}_st group by all),
    {name} as (select * from (select *, row_number() over (partition by {query} order by score desc, {key}) - 1 as rank from {name}_sc) where rank < {pool})"""


def dense(name: str, asked: str, query: str, vectors: str, key: str, k: int, where: str = "true") -> str:
    """CTEs that end in name(query, key, sim, rank); asked has (query, q), vectors (key, v), as double lists."""
    return f"""{name}_s as (select {query}, {key}, round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 6) as sim from {asked} a, {vectors} b where {where}),
    {name} as (select * from (select *, row_number() over (partition by {query} order by sim desc, {key}) - 1 as rank from {name}_s) where rank < {k})"""


def numbers(of: str) -> str:
    """The list of fact-like numbers of a text. RE2 looks neither ahead nor back: what stands in front is consumed, and behind is a word's end, for which underscores become spaces."""
    found = f"regexp_extract_all(replace(coalesce({of}, ''), '_', ' '), '(?:^|[^0-9A-Za-z.])([0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?)\\b', 1)"
    return f"list_filter({found}, lambda z: contains(z, ',') or contains(z, '.') or length(z) >= 5)"
